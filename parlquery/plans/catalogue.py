"""Every operator as a query over the given tables, with SQL that says the same.

Floating-point results are rounded, and orders end in a key, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx
from ..functions import time as tm
from ..functions import vector as vectors
from ..operators import chunking, conversation, excerpt, filters, fts, maintain, rank, vector
from ..sources import manifest, producers, views
from ..sources.views import NOW_MS, with_views
from . import search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIGITS = 9


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return add


def tables(spark: SparkSession, sf: str, bare: bool = False) -> dict[str, DataFrame]:
    return {
        "sessions": views.sessions(spark, sf),
        "messages": views.messages(spark, sf),
        "qa_chunks": views.chunks(spark, sf, bare),
        "vec_chunks": views.vectors(spark, sf),
        "session_files": views.session_files(spark, sf),
    }


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, DIGITS) for n in names})


# Messages, sessions and chunks.


@query(with_views("messages") + "SELECT msg_id, session_id, role, text FROM messages")
def messages_clean(spark, sf):
    return views.messages(spark, sf)


@query(with_views("messages") + "SELECT msg_id, role, text FROM messages WHERE session_id = '7' ORDER BY msg_id")
def conversation_ordered(spark, sf):
    return conversation.ordered(views.messages(spark, sf), "7")


@query(with_views("messages") + "SELECT session_id, arg_min(text, msg_id) AS text FROM messages WHERE role = 'user' GROUP BY session_id")
def first_user_turn(spark, sf):
    return maintain.first_user_turns(views.messages(spark, sf))


_TYPE = "CASE WHEN text IS NOT NULL AND (" + " OR ".join(f"starts_with(ltrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '{m}')" for m in tx.AUTOMATED_MARKERS) + ") THEN 'automated' ELSE 'interactive' END"
_MARKED = "SELECT session_id, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN chr(10) || '  <command-message>' || text ELSE text END AS text FROM (SELECT session_id, arg_min(text, msg_id) AS text FROM messages WHERE role = 'user' GROUP BY session_id)"


@query(with_views("messages") + f", turns AS ({_MARKED}) SELECT session_id, {_TYPE} AS session_type FROM turns")
def classify_first_turn(spark, sf):
    turns = maintain.first_user_turns(views.messages(spark, sf))
    marked = F.when(F.col("session_id").cast("bigint") % 3 == 0, F.concat(F.lit("\n  <command-message>"), F.col("text"))).otherwise(F.col("text"))
    return turns.select("session_id", tx.classify_first_turn(marked).alias("session_type"))


@query(with_views("messages", "sessions") + f"SELECT {_TYPE} AS session_type, count(*) AS n FROM sessions LEFT JOIN (SELECT session_id, arg_min(text, msg_id) AS text FROM messages WHERE role = 'user' GROUP BY session_id) USING (session_id) WHERE session_type IS NULL GROUP BY ALL")
def classify_counts(spark, sf):
    found = maintain.classify(views.sessions(spark, sf), views.messages(spark, sf))
    return found.groupBy("session_type").agg(F.count("*").alias("n"))


@query(with_views("sessions", "messages") + f"SELECT s.session_id, coalesce(CASE WHEN session_type IS NULL THEN {_TYPE} END, session_type) AS session_type FROM sessions s LEFT JOIN (SELECT session_id, arg_min(text, msg_id) AS text FROM messages WHERE role = 'user' GROUP BY session_id) USING (session_id)")
def reclassified_sessions(spark, sf):
    return maintain.reclassified(views.sessions(spark, sf), views.messages(spark, sf)).select("session_id", "session_type")


@query(with_views("groups") + "SELECT session_id, lo, hi, u AS \"user\", a AS assistant FROM groups")
def qa_chunk_groups(spark, sf):
    return chunking.groups(views.messages(spark, sf))


@query(with_views("chunks") + "SELECT chunk_id, session_id, content FROM chunks")
def qa_chunk_content(spark, sf):
    return views.chunks(spark, sf).select("chunk_id", "session_id", "content")


@query(with_views("chunks") + "SELECT chunk_id, lo, hi, timestamp_ms FROM chunks")
def qa_chunk_ranges(spark, sf):
    return views.chunks(spark, sf).select("chunk_id", "lo", "hi", "timestamp_ms")


def sql_pieces(most: int) -> str:
    """Texts of more than ``most`` bytes cut one piece after the other; ``e`` is
    the last character that fits, ``cut`` where the piece ends."""
    return f"""WITH RECURSIVE long AS (SELECT doc_id, text FROM documents WHERE strlen(text) > {most}),
        chars AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS c FROM long),
        sums AS (SELECT doc_id, i, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM chars),
        steps AS (
            SELECT doc_id, CAST(-1 AS BIGINT) AS part, CAST('' AS VARCHAR) AS content, text AS rest FROM long
            UNION ALL
            SELECT doc_id, part + 1, substr(rest, 1, cut), ltrim(substr(rest, cut + 1), chr(10)) FROM (
                SELECT doc_id, part, rest, CASE
                    WHEN strlen(rest) <= {most} THEN length(rest)
                    WHEN contains(head, chr(10) || chr(10)) THEN length(head) - strpos(reverse(head), chr(10) || chr(10)) + 1
                    WHEN contains(head, chr(10)) THEN length(head) - strpos(reverse(head), chr(10)) + 1
                    ELSE length(head) END AS cut
                FROM (
                    SELECT doc_id, part, rest, substr(rest, 1, CAST(len(list_filter(list_transform(range(1, least(length(rest), {most}) + 1), lambda i: strlen(substr(rest, 1, i))), lambda b: b <= {most})) AS BIGINT)) AS head
                    FROM steps WHERE rest <> '')))
        SELECT doc_id, CAST(part AS INTEGER) AS part, content FROM steps WHERE part >= 0
        UNION ALL SELECT doc_id, CAST(0 AS INTEGER), text FROM documents WHERE text IS NULL OR strlen(text) <= {most}"""


@query(sql_pieces(model.CHUNK_BYTES))
def split_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(tx.contents(F.col("text"), F.lit(None).cast("string"))).alias("part", "content"))


# Scalar functions.

_ROWS = "FROM messages"


@query(with_views("messages") + "SELECT msg_id, replace(text, 'é', '') AS text " + _ROWS)
def strip_noise(spark, sf):
    """Every é of a text is wrapped in a noise tag, which takes it away."""
    tag = tx.NOISE_TAGS[2]
    noisy = F.regexp_replace("text", "é", f"<{tag}>é\n</{tag}>")
    return views.messages(spark, sf).select("msg_id", tx.strip_noise_tags(noisy).alias("text"))


@query(with_views("messages") + "SELECT msg_id, replace(text, 'e', ' ') AS text " + _ROWS)
def strip_control(spark, sf):
    """Colour codes around tabs go, and the tabs become spaces."""
    noisy = F.replace(F.col("text"), F.lit("e"), F.lit("\x1b[31m\t\x1b]0;x\x07\x0b\x9b"))
    return views.messages(spark, sf).select("msg_id", tx.strip_control(noisy).alias("text"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 - 32400000 AS ahead, CAST(NULL AS BIGINT) AS wrong FROM events")
def iso_timestamp(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    e = e.withColumn("s", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    out = [tm.iso_ms(F.concat("s", F.lit(z))) for z in ("Z", "+09:00")]
    wrong = tm.iso_ms(F.regexp_replace("s", "T[0-9]{2}", "T24"))
    return e.select("event_id", out[0].alias("ms"), out[1].alias("ahead"), wrong.alias("wrong"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS days, strftime(ts, '%Y-%m-%d') AS day FROM events")
def civil_date(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    ms = tm.iso_ms(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return e.select("event_id", tm.civil_days(F.year("ts"), F.month("ts"), F.day("ts")).alias("days"), tm.format_day(ms).alias("day"))


_DECAY = f"CASE WHEN timestamp_ms IS NULL THEN 0.0::DOUBLE ELSE exp(-ln(2.0) * (greatest({NOW_MS} - timestamp_ms, 0) / 86400000.0::DOUBLE) / 30) END"


@query(with_views("sessions") + f"SELECT session_id, round({_DECAY}, {DIGITS}) AS decay FROM sessions")
def recency_decay(spark, sf):
    return _round(views.sessions(spark, sf).select("session_id", tm.recency_decay(F.col("timestamp_ms"), NOW_MS).alias("decay")), "decay")


@query(with_views("sessions") + "SELECT session_id, 'proj-' || (CAST(session_id AS BIGINT) % 7) AS name, 'show ' || session_id || ' --chunk 5' AS hint, 'abc' AS parent FROM sessions")
def display_columns(spark, sf):
    s = views.sessions(spark, sf)
    return s.select("session_id", tx.display_name(F.col("project")).alias("name"), tx.inspect_hint(F.col("session_id"), F.lit(5)).alias("hint"), tx.parent_session(F.lit("/x/abc/subagents/f.jsonl")).alias("parent"))


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || '…' ELSE text END AS text FROM documents")
def cap_messages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", tx.cap_message(F.col("text")).alias("text"))


# Keyword search.

_GRAMS = "SELECT msg_id, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) AS trigram FROM (SELECT msg_id, lower(text) AS t FROM messages UNION ALL SELECT msg_id, lower(role) FROM messages)"


@query(with_views("messages") + f", g AS ({_GRAMS}) SELECT trigram, count(DISTINCT msg_id) AS doc, count(*) AS cnt FROM g GROUP BY trigram")
def trigram_vocab(spark, sf):
    return fts.vocabulary(views.messages(spark, sf))


_DL = "greatest(length(role) - 2, 0) + greatest(length(text) - 2, 0)"


@query(with_views("messages") + f"SELECT count(*) AS n, round(avg({_DL}), {DIGITS}) AS avgdl, CAST(sum({_DL}) AS BIGINT) AS total FROM messages")
def doc_length_stats(spark, sf):
    dl = fts.length()
    return _round(views.messages(spark, sf).agg(F.count("*").alias("n"), F.avg(dl).alias("avgdl"), F.sum(dl).alias("total")), "avgdl")


def _sql_holds(p: str) -> str:
    return f"(contains(lower(text), '{p}') OR contains(lower(role), '{p}'))"


@query(with_views("messages") + f"SELECT msg_id FROM messages WHERE {_sql_holds('tion de')} AND {_sql_holds('ent')}")
def phrase_match(spark, sf):
    m = views.messages(spark, sf)
    return fts.matches(m, fts.prepare(m, '"tion de" ENT')).select("msg_id")


_SHORT = f", g AS ({_GRAMS}) SELECT m.msg_id FROM messages m WHERE EXISTS (SELECT 1 FROM g WHERE g.msg_id = m.msg_id AND starts_with(trigram, 'üb')) AND {_sql_holds('keit')}"


@query(with_views("messages") + _SHORT)
def short_term_match(spark, sf):
    m = views.messages(spark, sf)
    return fts.matches(m, fts.prepare(m, "üb keit")).select("msg_id")


@query(with_views("messages") + f"SELECT msg_id FROM messages WHERE {_sql_holds('tion')}")
def postings_match(spark, sf):
    m = views.messages(spark, sf)
    return fts.lookup(fts.postings(m), m, "tion").select("msg_id")


def sql_bm25(phrases: list[str]) -> str:
    """Named queries up to ``bm25(msg_id, session_id, rank)``."""
    tf = lambda p, c: f"len(list_filter(range(1, greatest(length({c}) - {len(p) - 2}, 1)), lambda i: substr({c}, i, {len(p)}) = '{p}'))"
    tfs = ", ".join(f"{tf(p, 't')} + {tf(p, 'r')} AS tf{k}" for k, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (WHERE tf{k} > 0) AS df{k}" for k in range(len(phrases)))
    idf = lambda k: f"CASE WHEN ln((n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) END"
    parts = " + ".join(f"({idf(k)}) * (tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))" for k in range(len(phrases)))
    every = " AND ".join(f"tf{k} > 0" for k in range(len(phrases)))
    return (
        f", low AS (SELECT msg_id, session_id, lower(role) AS r, lower(text) AS t, {_DL} AS dl FROM messages)"
        f", tfs AS (SELECT *, {tfs} FROM low), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM tfs)"
        f", bm25 AS (SELECT msg_id, session_id, -({parts}) AS rank FROM tfs, st WHERE {every})\n"
    )


def _bm25_query(name: str, phrases: list[str]) -> None:
    sql = with_views("messages") + sql_bm25(phrases) + f"SELECT msg_id, session_id, round(rank, {DIGITS}) AS rank FROM bm25"

    @query(sql, name)
    def bm25(spark, sf):
        return _round(fts.bm25(views.messages(spark, sf), [[p] for p in phrases]), "rank")


    @query(sql, f"{name}_index")
    def bm25_index(spark, sf):
        return _round(fts.bm25(*indexed(spark, sf, [[p] for p in phrases])), "rank")


def indexed(spark, sf, groups: fts.Groups) -> tuple:
    """What ``fts.bm25`` takes where there is an index of trigrams."""
    m = views.messages(spark, sf)
    facts = m.agg(F.count("*").alias("messages"), F.sum(fts.length()).alias("trigrams"))
    return m, groups, fts.postings(m), facts


_bm25_query("bm25_one", ["keit"])
_bm25_query("bm25_two", ["tion", "ent"])
_bm25_query("bm25_three", ["the", "ing", "tion"])
_bm25_query("bm25_role_hit", ["user"])

TERMS = ["tion"]
_GROUPS = [[t] for t in TERMS]
_BEST = "best AS (SELECT session_id, rank, msg_id FROM bm25 {where} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rank, msg_id) = 1 ORDER BY round(rank, 9), session_id LIMIT {k})"


def sql_best(where: str, limit: int = model.LIMIT_DEFAULT) -> str:
    return sql_bm25(TERMS) + ", " + _BEST.format(where=where, k=model.OVERSAMPLE * limit) + "\n"


_OPEN = "WHERE session_id IN (SELECT session_id FROM sessions WHERE coalesce(session_type, 'interactive') <> 'automated')"
_BOOST = f"(1 + 0.2::DOUBLE * {_DECAY})"
_RANKED = f"ranked AS (SELECT b.session_id, rank * {_BOOST} AS rank, msg_id FROM best b JOIN sessions USING (session_id) WHERE source IN ('claude', 'codex') ORDER BY round(rank * {_BOOST}, 9), session_id LIMIT 10)"


def _opts(**kw) -> model.SearchOptions:
    return model.SearchOptions(now_ms=NOW_MS, **kw)


@query(with_views("messages") + sql_best("") + f"SELECT session_id, round(rank, {DIGITS}) AS rank, msg_id FROM best")
def fts_candidates(spark, sf):
    return _round(fts.candidates(fts.bm25(views.messages(spark, sf), _GROUPS), model.LIMIT_DEFAULT), "rank")


@query(with_views("messages", "sessions") + sql_best(_OPEN) + f", {_RANKED} SELECT session_id, round(rank, {DIGITS}) AS rank FROM ranked")
def fts_ranked_recency(spark, sf):
    t = {"sessions": views.sessions(spark, sf), "messages": views.messages(spark, sf)}
    return _round(search.keyword_ranked(t, _GROUPS, _opts()).select("session_id", "rank"), "rank")


@query(with_views("messages", "sessions") + sql_best(_OPEN) + f", {_RANKED} SELECT session_id, round(rank, {DIGITS}) AS rank FROM ranked")
def fts_ranked_index(spark, sf):
    m, groups, index, facts = indexed(spark, sf, _GROUPS)
    t = {"sessions": views.sessions(spark, sf), "messages": m, "postings": index, "facts": facts}
    return _round(search.keyword_ranked(t, groups, _opts()).select("session_id", "rank"), "rank")


# Semantic search.

_NEAR = "far AS (SELECT v.chunk_id, list_distance(v.embedding, q.embedding) AS distance FROM vectors v, (SELECT embedding FROM vectors WHERE chunk_id = 1) q), near AS (SELECT * FROM far ORDER BY round(distance, 9), chunk_id LIMIT {k})"


@query(with_views("vectors") + ", " + _NEAR.format(k=30) + f" SELECT chunk_id, round(distance, {DIGITS}) AS distance FROM near")
def vec_knn(spark, sf):
    return _round(vector.nearest(views.vectors(spark, sf), views.query_vector(spark, sf), 30).drop("sub_idx"), "distance")


def sql_vec(where: str, k: int = 30) -> str:
    return ", " + _NEAR.format(k=k) + f", vec AS (SELECT session_id, min(distance) AS distance, arg_min(chunk_id, (distance, chunk_id)) AS chunk_id FROM near JOIN chunks USING (chunk_id) {where} GROUP BY session_id)\n"


_VEC = f"SELECT session_id, round(distance, {DIGITS}) AS distance, chunk_id FROM vec"


def _vec_leg(spark, sf, opts):
    return _round(search.vector_leg(tables(spark, sf), views.query_vector(spark, sf), opts), "distance")


@query(with_views("vectors", "chunks", "sessions") + sql_vec(_OPEN) + _VEC)
def vec_session_nearest(spark, sf):
    return _vec_leg(spark, sf, _opts())


_ONE = "WHERE session_id IN (SELECT session_id FROM sessions WHERE starts_with(project, '/home/u/proj-3') AND coalesce(session_type, 'interactive') <> 'automated')"


@query(with_views("vectors", "chunks", "sessions") + sql_vec(_ONE) + _VEC)
def vec_postfilter_starved(spark, sf):
    return _vec_leg(spark, sf, _opts(project="/home/u/proj-3"))


@query(with_views("vectors", "chunks", "sessions") + f", far AS (SELECT v.chunk_id, list_distance(v.embedding, q.embedding) AS distance FROM vectors v, (SELECT embedding FROM vectors WHERE chunk_id = 1) q), own AS (SELECT chunk_id, session_id, distance FROM far JOIN chunks USING (chunk_id) {_ONE} ORDER BY round(distance, 9), chunk_id LIMIT 30) SELECT session_id, round(min(distance), {DIGITS}) AS distance, arg_min(chunk_id, (distance, chunk_id)) AS chunk_id FROM own GROUP BY session_id")
def vec_prefilter(spark, sf):
    return _vec_leg(spark, sf, _opts(project="/home/u/proj-3", prefilter=True))


# Fusion.

_FUSED = (
    ", pos AS (SELECT session_id, row_number() OVER (ORDER BY round(rank, 9), session_id) - 1 AS pos FROM best UNION ALL SELECT session_id, row_number() OVER (ORDER BY round(distance, 9), session_id) - 1 FROM vec)"
    ", fused AS (SELECT session_id, sum(1.0::DOUBLE / (60 + pos)) AS score FROM pos GROUP BY session_id)\n"
)
_HYBRID = f", hybrid AS (SELECT session_id, score * {_BOOST} AS score FROM fused JOIN sessions USING (session_id) WHERE source IN ('claude', 'codex') ORDER BY round(score * {_BOOST}, 9) DESC, session_id LIMIT 10)\n"
_ALL = ("messages", "groups", "sessions", "chunks", "vectors")


def _legs(spark, sf, opts):
    t = tables(spark, sf)
    return t, search.keyword_leg(t, _GROUPS, opts), search.vector_leg(t, views.query_vector(spark, sf), opts)


@query(with_views(*_ALL) + sql_best(_OPEN) + sql_vec(_OPEN) + _FUSED + f"SELECT session_id, round(score, {DIGITS}) AS score FROM fused")
def rrf_merge(spark, sf):
    _, words, near = _legs(spark, sf, _opts())
    return _round(rank.fuse(words, near), "score")


@query(with_views(*_ALL) + sql_best(_OPEN) + sql_vec(_OPEN) + _FUSED + _HYBRID + f"SELECT session_id, round(score, {DIGITS}) AS score FROM hybrid")
def hybrid_search(spark, sf):
    t, words, near = _legs(spark, sf, _opts())
    return _round(search.hybrid_ranked(words, near, t["sessions"], _opts()).select("session_id", "score"), "score")


# Filters, each on both legs and the list of files.

_NOT_AUTO = "coalesce(session_type, 'interactive') <> 'automated'"
FILTERS = {
    "project": ({"project": "/HOME/u/proj-3"}, f"starts_with(lower(project), '/home/u/proj-3') AND {_NOT_AUTO}"),
    "days": ({"days": 7}, f"timestamp_ms >= {NOW_MS - 7 * model.DAY_MS} AND {_NOT_AUTO}"),
    "source": ({"source": "codex"}, f"source = 'codex' AND {_NOT_AUTO}"),
    "file": ({"file": "fr/825"}, f"session_id IN (SELECT session_id FROM session_files WHERE path = 'fr/825' OR ends_with(lower(path), '/fr/825')) AND {_NOT_AUTO}"),
    "current_exclude": ({"current": model.CurrentSession("exclude", "7")}, f"session_id <> '7' AND {_NOT_AUTO}"),
    "current_only": ({"current": model.CurrentSession("only", "7")}, f"session_id = '7' AND {_NOT_AUTO}"),
    "automated": ({"include_automated": True}, "true"),
}


def _filter_queries(kind: str, options: dict, condition: str) -> None:
    where = f"WHERE session_id IN (SELECT session_id FROM sessions WHERE {condition})"
    opts = _opts(**options)
    need = ("session_files",) if kind == "file" else ()

    @query(with_views("messages", "sessions", *need) + sql_best(where) + f"SELECT session_id, round(rank, {DIGITS}) AS rank, msg_id FROM best", f"filter_{kind}_fts")
    def leg(spark, sf):
        return _round(search.keyword_leg(tables(spark, sf), _GROUPS, opts), "rank")

    @query(with_views("vectors", "chunks", "sessions", *need) + sql_vec(where) + _VEC, f"filter_{kind}_vec")
    def near(spark, sf):
        return _vec_leg(spark, sf, opts)

    @query(with_views("sessions", *need) + f"SELECT session_id, timestamp_ms FROM sessions WHERE {condition} AND source IN ('claude', 'codex') ORDER BY timestamp_ms DESC NULLS LAST, session_id LIMIT 10", f"filter_{kind}_files")
    def files(spark, sf):
        return search.file_list(tables(spark, sf), opts).select("session_id", "timestamp_ms")


for _kind, (_options, _condition) in FILTERS.items():
    _filter_queries(_kind, _options, _condition)


@query(with_views("sessions") + "SELECT session_id, source FROM sessions WHERE source IN ('claude', 'codex')")
def prune_unknown_source(spark, sf):
    return filters.known_sources(views.sessions(spark, sf)).select("session_id", "source")


@query(with_views("sessions") + f"SELECT session_id, source, project, slug, timestamp_ms FROM sessions WHERE {_NOT_AUTO} AND source IN ('claude', 'codex') ORDER BY timestamp_ms DESC NULLS LAST, session_id LIMIT 10")
def file_list(spark, sf):
    return search.file_list(tables(spark, sf), _opts())


# Excerpts.


def _hits(spark, sf):
    return fts.candidates(fts.bm25(views.messages(spark, sf), _GROUPS), model.LIMIT_DEFAULT)


@query(with_views("messages", "groups", "sessions", "chunks") + sql_best("") + "SELECT b.session_id, max(content) AS content, max(chunk_id) AS chunk_id FROM best b JOIN chunks c ON b.session_id = c.session_id AND msg_id BETWEEN lo AND hi GROUP BY b.session_id HAVING count(*) = 1")
def excerpt_range_tier(spark, sf):
    return excerpt.by_range(_hits(spark, sf), views.chunks(spark, sf))


@query(with_views("messages", "groups", "sessions", "chunks") + sql_best("") + "SELECT b.session_id, max(content) AS content FROM best b JOIN messages m USING (msg_id) JOIN chunks c ON c.session_id = b.session_id AND contains(content, text) WHERE CAST(c.session_id AS BIGINT) % 2 = 1 GROUP BY b.session_id HAVING count(*) = 1")
def excerpt_substring_tier(spark, sf):
    return excerpt.by_substring(_hits(spark, sf), views.messages(spark, sf), views.chunks(spark, sf, bare=True))


@query(with_views("vectors", "chunks", "sessions") + sql_vec(_OPEN) + "SELECT v.session_id, content, v.chunk_id FROM vec v JOIN chunks c USING (chunk_id)")
def excerpt_vector_tier(spark, sf):
    t = tables(spark, sf)
    return excerpt.by_vector(search.vector_leg(t, views.query_vector(spark, sf), _opts()), t["qa_chunks"])


@query()
def excerpt_snippet(spark, sf):
    m = views.messages(spark, sf)
    return excerpt.by_snippet(_hits(spark, sf), m, fts.matches(m, _GROUPS), TERMS)


@query(with_views("messages", "groups", "sessions", "chunks") + sql_best(_OPEN) + f""", {_RANKED}
    , one AS (SELECT r.session_id, max(content) AS content, max(chunk_id) AS chunk_id FROM ranked r JOIN chunks c ON r.session_id = c.session_id AND msg_id BETWEEN lo AND hi GROUP BY r.session_id HAVING count(*) = 1)
    SELECT r.session_id, content AS excerpt, chunk_id AS chunk FROM ranked r JOIN one USING (session_id)""")
def search_page(spark, sf):
    """A whole keyword search, as callers get it."""
    page, _ = search.search(tables(spark, sf), TERMS[0], _opts())
    return page.filter("chunk is not null").select("session_id", "excerpt", "chunk")


# Conversations.

_POS = ", own AS (SELECT *, row_number() OVER (ORDER BY msg_id) AS pos FROM messages WHERE session_id = '7')"


@query(with_views("messages") + _POS + f", body AS (SELECT min(pos) AS a, max(pos) AS b FROM own WHERE msg_id BETWEEN {7 * views.TURNS + 2} AND {7 * views.TURNS + 3}) SELECT msg_id, role, text FROM own, body WHERE pos BETWEEN a - 1 AND b + 1")
def show_window(spark, sf):
    return conversation.window(views.messages(spark, sf), "7", 7 * views.TURNS + 2, 7 * views.TURNS + 3, 1)


@query(with_views("sessions") + "SELECT session_id, slug FROM sessions WHERE starts_with(session_id, '1')")
def show_prefix_matches(spark, sf):
    return conversation.with_prefix(views.sessions(spark, sf), "1").select("session_id", "slug")


# Counts, pending work, repairs.


@query(with_views("chunks", "sessions") + "SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM sessions WHERE session_type = 'automated') AS automated")
def status_counts(spark, sf):
    return maintain.status(tables(spark, sf))


@query(with_views("chunks") + "SELECT chunk_id, session_id FROM chunks WHERE chunk_id NOT IN (SELECT vec_id + 1 FROM embeddings WHERE vec_id % 3 = 0) ORDER BY timestamp_ms DESC NULLS LAST, chunk_id LIMIT 50")
def pending_chunks(spark, sf):
    some = views.vectors(spark, sf).filter("(chunk_id - 1) % 3 = 0")
    return maintain.pending_chunks(views.chunks(spark, sf), some, 50).select("chunk_id", "session_id")


@query(with_views("chunks", "sessions") + "SELECT session_id FROM sessions WHERE session_id NOT IN (SELECT session_id FROM chunks WHERE chunk_id % 4 = 0)")
def unchunked_sessions(spark, sf):
    return chunking.unchunked(views.sessions(spark, sf), views.chunks(spark, sf).filter("chunk_id % 4 = 0")).select("session_id")


@query(with_views("chunks") + "SELECT DISTINCT session_id FROM chunks WHERE chunk_id IN (SELECT vec_id + 1 FROM embeddings)")
def embedded_sessions(spark, sf):
    return maintain.embedded_sessions(views.chunks(spark, sf), views.vectors(spark, sf))


@query(with_views("chunks") + "SELECT vec_id + 1 AS chunk_id FROM embeddings WHERE vec_id + 1 NOT IN (SELECT chunk_id FROM chunks)")
def orphan_embeddings(spark, sf):
    return maintain.orphan_embeddings(views.vectors(spark, sf), views.chunks(spark, sf)).select("chunk_id")


@query(with_views("chunks", "sessions") + "SELECT chunk_id FROM chunks WHERE session_id IN (SELECT session_id FROM sessions WHERE source = 'mystery')")
def orphan_chunks(spark, sf):
    return maintain.orphan_chunks(views.chunks(spark, sf), filters.known_sources(views.sessions(spark, sf))).select("chunk_id")


@query(with_views("chunks", "sessions") + "SELECT chunk_id FROM chunks WHERE session_id IN (SELECT session_id FROM sessions WHERE source <> 'mystery') AND chunk_id IN (SELECT vec_id + 1 FROM embeddings)")
def repair_orphans(spark, sf):
    t = tables(spark, sf)
    t["sessions"] = filters.known_sources(t["sessions"])
    return maintain.repaired(t)["vec_chunks"].select("chunk_id")


@query(with_views("chunks") + "SELECT chunk_id, lo, hi FROM chunks WHERE CAST(session_id AS BIGINT) % 2 = 1 AND CAST(session_id AS BIGINT) % 3 <> 0")
def backfill_ranges(spark, sf):
    """Odd sessions lack ranges; those whose content was changed stay so."""
    bare = views.chunks(spark, sf, bare=True)
    changed = F.when(F.col("session_id").cast("bigint") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return chunking.backfill_ranges(bare.withColumn("content", changed), views.messages(spark, sf))


@query(with_views("chunks") + "SELECT chunk_id, (row_number() OVER (ORDER BY strlen(content), chunk_id) - 1) // 128 AS batch FROM chunks")
def embed_batches(spark, sf):
    return vectors.batch_numbers(views.chunks(spark, sf))


# Files.


def _manifest(spark, sf):
    """Of the sessions' files one in seven is gone, one in five is newer, and
    some are not indexed yet."""
    n = F.col("session_id").cast("bigint")
    s = views.sessions(spark, sf)
    there = s.filter(n % 7 != 6).select(F.col("file_path").alias("path"), "source", F.when(n % 5 == 0, 5.0).otherwise(0.0).alias("mtime"))
    more = s.filter(n % 10 == 0).select(F.concat("file_path", F.lit(".new")).alias("path"), "source", F.lit(1.0).alias("mtime"))
    return manifest.diff(there.unionByName(more), s)


_DIFF = "files AS (SELECT file_path AS path, source, session_id, CASE WHEN CAST(session_id AS BIGINT) % 7 = 6 THEN 'orphan' WHEN CAST(session_id AS BIGINT) % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM sessions UNION ALL SELECT file_path || '.new', source, NULL, 'new' FROM sessions WHERE CAST(session_id AS BIGINT) % 10 = 0)"


@query(with_views("sessions") + f", {_DIFF} SELECT path, source, session_id, state FROM files")
def manifest_diff(spark, sf):
    return _manifest(spark, sf)


@query(with_views("sessions") + f", {_DIFF} SELECT path FROM files WHERE state = 'orphan' AND source = 'claude'")
def orphan_cleanup_guarded(spark, sf):
    roots = [manifest.Root("claude", "/a"), manifest.Root("codex", "/b", "incomplete_enumeration")]
    return manifest.orphans(_manifest(spark, sf), roots).select("path")


@query(with_views("sessions") + "SELECT 'codex' AS source, '/b' AS path, 'incomplete_enumeration' AS reason, count(*) AS preserved FROM sessions WHERE source = 'codex'")
def skipped_roots(spark, sf):
    roots = [manifest.Root("claude", "/a"), manifest.Root("codex", "/b", "incomplete_enumeration"), manifest.Root("none", "/c", "missing_root")]
    return manifest.skipped_roots(views.sessions(spark, sf), roots)


_PARSED = "SELECT '/logs/s' || session_id || '.jsonl' AS path, CAST(msg_id % {t} AS BIGINT) AS line_no, role, text FROM messages WHERE text <> ''".format(t=views.TURNS)


@query(with_views("messages") + _PARSED)
def parse_producer_a(spark, sf):
    return producers.parse_a(views.json_lines(spark, sf, "claude")).messages


@query(with_views("messages") + _PARSED)
def parse_producer_b(spark, sf):
    return producers.parse_b(views.json_lines(spark, sf, "codex")).messages


_TURN = f"msg_id % {views.TURNS}"


def _lines(spark, sf, source: str, text):
    """Lines of a producer whose texts are made from ``text`` and ``turn``."""
    rows = views.conversations(spark, sf).withColumn("text", text)
    return views.json_lines(spark, sf, source, rows)


@query(with_views("messages") + _PARSED + f" AND {_TURN} % 3 <> 0")
def parse_meta_lines(spark, sf):
    """Every third line is marked as meta and is dropped."""
    lines = views.json_lines(spark, sf, "claude")
    marked = F.concat(F.lit('{"isMeta":true,'), F.substr("raw", F.lit(2)))
    return producers.parse_a(lines.withColumn("raw", F.when(F.col("line_no") % 3 == 0, marked).otherwise(F.col("raw")))).messages


@query(with_views("messages") + _PARSED + f" AND {_TURN} % 5 = 4")
def parse_boilerplate(spark, sf):
    """Four texts of five begin like boilerplate of the second producer."""
    begun = F.when(F.col("turn") % 5 == 4, F.col("text"))
    for k, start in enumerate(tx.BOILERPLATE):
        begun = begun.when(F.col("turn") % 5 == k, F.concat(F.lit(start), F.col("text")))
    return producers.parse_b(_lines(spark, sf, "codex", begun)).messages


@query(with_views("messages") + "SELECT DISTINCT 's' || session_id AS session_id FROM messages WHERE text <> '' AND CAST(session_id AS BIGINT) % 2 = 0")
def parse_empty_files(spark, sf):
    """Files that hold nothing but noise are no sessions."""
    tag = tx.NOISE_TAGS[2]
    noise = F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.lit(f"<{tag}>all of it</{tag}>"))
    return producers.parse_a(_lines(spark, sf, "claude", noise)).sessions.select("session_id")


@query("SELECT page_id, CASE WHEN trim(url) <> '' THEN trim(url) END AS cwd FROM pages")
def legacy_folder(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    said = F.concat(F.lit("<environment_context>\nCurrent working directory: "), F.col("url"), F.lit(" \nmore"))
    return pages.select("page_id", producers.cwd_of_text(said).alias("cwd"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 2 = 0 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 8) END AS short FROM events")
def names_of_paths(spark, sf):
    """The day in a path, and the beginning of an id in a file's name."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    name = F.concat(F.lit("rollout-2026-01-18T00-00-00-"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), F.when(F.col("event_id") % 2 == 0, part(21, 12)).otherwise(part(21, 11))))
    path = F.concat(F.lit("/h/sessions/"), F.date_format("ts", "yyyy/MM/dd"), F.lit("/f.jsonl"))
    return e.select("event_id", producers.date_of_path(path).alias("day"), producers.short_uuid(name).alias("short"))


_SESSIONS_OF_FILES = "SELECT 's' || session_id AS session_id, '{source}' AS source, '/logs/s' || session_id || '.jsonl' AS path, '{project}' AS project, substr('s' || session_id, 1, {n}) AS slug, 1704448800250 AS timestamp_ms FROM (SELECT DISTINCT session_id FROM messages WHERE text <> '')"


@query(with_views("messages") + _SESSIONS_OF_FILES.format(source="claude", project="/home/u", n=12))
def parse_sessions_a(spark, sf):
    return producers.parse_a(views.json_lines(spark, sf, "claude")).sessions


@query(with_views("messages") + _SESSIONS_OF_FILES.format(source="codex", project="", n=8))
def parse_sessions_b(spark, sf):
    return producers.parse_b(views.json_lines(spark, sf, "codex")).sessions


@query("SELECT DISTINCT '/logs/w' || (page_id % 10) || '.jsonl' AS path, url AS file FROM pages WHERE url <> ''")
def scanned_files(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    block = F.struct(F.lit("tool_use").alias("type"), F.lit("Write").alias("name"), F.struct(F.col("url").alias("file_path")).alias("input"))
    line = F.struct(F.lit("assistant").alias("type"), F.struct(F.array(block).alias("content")).alias("message"))
    lines = pages.select(F.concat(F.lit("/logs/w"), (F.col("page_id") % 10).cast("string"), F.lit(".jsonl")).alias("path"), F.col("page_id").alias("line_no"), F.to_json(line).alias("raw"))
    return producers.parse_a(lines).files.select("path", "file")


@query("SELECT '/logs/s' || conv_id || '.jsonl' AS path, count(*) FILTER (WHERE turn % 3 = 1) AS skipped FROM conversations GROUP BY conv_id")
def skipped_lines(spark, sf):
    lines = views.json_lines(spark, sf, "claude")
    return producers.parse_a(lines.withColumn("raw", F.when(F.col("line_no") % 3 == 1, F.concat(F.lit("{"), "raw")).otherwise(F.col("raw")))).skipped
