"""The engine's tables as views of the given ones, by plain arithmetic.

``SQL`` says the same for an oracle, as named queries to put behind ``WITH``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking

#: 2024-02-01 in UTC, later than every event.
NOW_MS = 1_706_745_600_000

#: Turns of a conversation that ids leave room for.
TURNS = 1 << 32


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def all_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    return rows.select((F.col("conv_id") * F.lit(TURNS) + F.col("turn")).alias("msg_id"), F.col("conv_id").cast("string").alias("session_id"), "role", "text")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_messages(spark, sf_dir).filter(F.col("role").isin("user", "assistant"))


def _ms(ts: Column, kind: str) -> Column:
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.unix_millis(ts)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    events = _table(spark, sf_dir, "events", "event_id", "ts")
    n = events.agg(F.count("*").alias("n")).select("n").scalar()
    one = conversations(spark, sf_dir).select("conv_id").distinct().withColumn("at", c * 97 % n)
    times = events.select(F.col("event_id").alias("at"), _ms(F.col("ts"), dict(events.dtypes)["ts"]).alias("ms"))
    return one.join(times, "at", "left").select(
        c.cast("string").alias("session_id"),
        F.when(c % 23 == 22, "mystery").when(c % 5 == 4, "codex").otherwise("claude").alias("source"),
        F.concat(F.lit("/logs/"), c.cast("string"), F.lit(".jsonl")).alias("file_path"),
        F.concat(F.lit("/home/u/proj-"), (c % 7).cast("string")).alias("project"),
        F.concat(F.lit("slug-"), c.cast("string")).alias("slug"),
        F.when(c % 17 != 16, F.col("ms")).alias("timestamp_ms"),
        F.lit(0.0).alias("mtime"),
        F.when(c % 13 == 12, "automated").when(c % 11 != 10, "interactive").alias("session_type"),
        F.lit(0).alias("files_scanned"),
    )


def chunks(spark: SparkSession, sf_dir: str, bare: bool = False) -> DataFrame:
    """Chunks with dense ids; ``bare`` leaves the ranges of odd sessions out."""
    said = messages(spark, sf_dir)
    found = chunking.numbered(chunking.chunks(said), said)
    times = sessions(spark, sf_dir).select("session_id", "timestamp_ms")
    out = found.join(times, "session_id").select("chunk_id", "session_id", "content", "timestamp_ms", "lo", "hi")
    if bare:
        keep = F.col("session_id").cast("bigint") % 2 == 0
        out = out.withColumns({"lo": F.when(keep, F.col("lo")), "hi": F.when(keep, F.col("hi"))})
    return out


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return rows.select((F.col("vec_id") + 1).alias("chunk_id"), F.lit(0).alias("sub_idx"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings", "vec_id", "embedding").filter("vec_id = 0").first()["embedding"])


def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = conversations(spark, sf_dir).agg(F.countDistinct("conv_id").alias("n")).select("n").scalar()
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    path = F.concat(F.lit("/home/u"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1))
    return pages.select((F.col("page_id") % n).cast("string").alias("session_id"), path.alias("path")).distinct()


def json_lines(spark: SparkSession, sf_dir: str, source: str, rows: DataFrame | None = None) -> DataFrame:
    """Conversations, or such rows, as the lines of a producer's session files."""
    rows = conversations(spark, sf_dir) if rows is None else rows
    name = F.concat(F.lit("/logs/s"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    ts = F.lit("2024-01-05T10:00:00.250Z")
    if source == "claude":
        line = F.struct(F.col("role").alias("type"), F.lit("/home/u").alias("cwd"), ts.alias("timestamp"), F.struct("role", F.col("text").alias("content")).alias("message"))
    else:
        block = F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text")))
        line = F.struct(F.lit("response_item").alias("type"), ts.alias("timestamp"), F.struct("role", block.alias("content")).alias("payload"))
    return rows.select(name.alias("path"), F.col("turn").alias("line_no"), F.to_json(line, {"ignoreNullFields": "false"}).alias("raw"))


#: Named queries of the same views.
SQL = {
    "all_messages": f"SELECT conv_id * {TURNS} + turn AS msg_id, CAST(conv_id AS VARCHAR) AS session_id, role, text FROM conversations",
    "messages": f"SELECT conv_id * {TURNS} + turn AS msg_id, CAST(conv_id AS VARCHAR) AS session_id, role, text FROM conversations WHERE role IN ('user', 'assistant')",
    "sessions": """SELECT CAST(conv_id AS VARCHAR) AS session_id,
        CASE WHEN conv_id % 23 = 22 THEN 'mystery' WHEN conv_id % 5 = 4 THEN 'codex' ELSE 'claude' END AS source,
        '/logs/' || conv_id || '.jsonl' AS file_path, '/home/u/proj-' || (conv_id % 7) AS project, 'slug-' || conv_id AS slug,
        CASE WHEN conv_id % 17 <> 16 THEN epoch_us(ts) // 1000 END AS timestamp_ms,
        CASE WHEN conv_id % 13 = 12 THEN 'automated' WHEN conv_id % 11 <> 10 THEN 'interactive' END AS session_type
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN events e ON e.event_id = conv_id * 97 % (SELECT count(*) FROM events)""",
    "groups": """SELECT session_id, lo, max(msg_id) AS hi, max(CASE WHEN role = 'user' THEN text END) AS u,
        string_agg(CASE WHEN role = 'assistant' AND text <> '' THEN text END, chr(10) ORDER BY msg_id) AS a
        FROM (SELECT *, max(CASE WHEN role = 'user' THEN msg_id END) OVER (PARTITION BY session_id ORDER BY msg_id) AS lo FROM messages)
        WHERE lo IS NOT NULL GROUP BY session_id, lo HAVING max(CASE WHEN role = 'user' THEN text END) <> ''""",
    "chunks": """SELECT row_number() OVER (ORDER BY lo) AS chunk_id, g.session_id, u || coalesce(chr(10) || a, '') AS content, timestamp_ms, lo, hi
        FROM groups g JOIN sessions USING (session_id)""",
    "vectors": "SELECT vec_id + 1 AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "session_files": """SELECT DISTINCT CAST(page_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS VARCHAR) AS session_id,
        '/home/u' || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages""",
}

_NEEDS = {"groups": ("messages",), "chunks": ("messages", "groups", "sessions")}


def with_views(*names: str) -> str:
    """``WITH`` and the named views with what they need, in order."""
    order = [n for n in SQL if any(n == m or n in _NEEDS.get(m, ()) for m in names)]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"
