"""Counts, checks and repairs of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx

Tables = dict[str, DataFrame]


def status(t: Tables) -> DataFrame:
    """``(sessions, chunks, embedded, automated)`` in one row."""
    s = t["sessions"].agg(F.count("*").alias("sessions"), F.count_if(F.col("session_type") == model.AUTOMATED).alias("automated"))
    return s.select(
        "sessions",
        t["qa_chunks"].agg(F.count("*").alias("n")).select("n").scalar().alias("chunks"),
        t["vec_chunks"].agg(F.countDistinct("chunk_id").alias("n")).select("n").scalar().alias("embedded"),
        "automated",
    )


def pending_chunks(chunks: DataFrame, vectors: DataFrame, budget: int | None = None) -> DataFrame:
    """Chunks without an embedding, the newest first, as many as the budget
    allows; those without a time come last."""
    out = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")
    if budget is None:
        return out
    return out.orderBy(F.col("timestamp_ms").desc_nulls_last(), "chunk_id").limit(budget)


def embedded_sessions(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_semi").select("session_id").distinct()


def orphan_embeddings(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings of chunks that are not there, null ids included."""
    return vectors.join(chunks.select("chunk_id").filter("chunk_id is not null"), "chunk_id", "left_anti")


def orphan_chunks(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    return chunks.join(sessions.select("session_id").filter("session_id is not null"), "session_id", "left_anti")


def repaired(t: Tables) -> Tables:
    """Chunks and embeddings without orphans; chunks first, as their embeddings follow."""
    chunks = t["qa_chunks"].join(t["sessions"].select("session_id"), "session_id", "left_semi")
    return {"qa_chunks": chunks, "vec_chunks": t["vec_chunks"].join(chunks.select("chunk_id"), "chunk_id", "left_semi")}


def doctor(t: Tables, dims: int | None = None) -> DataFrame:
    """``(name, ok, detail, remedy)`` of every check."""
    keys = {"sessions": "session_id", "messages": "msg_id", "qa_chunks": "chunk_id"}
    spark = t["sessions"].sparkSession
    rows = []
    for name, key in keys.items():
        twice = t[name].groupBy(key).count().filter("count > 1").count()
        rows.append((f"integrity of {name}", twice == 0, f"{twice} repeated keys", "rebuild" if twice else ""))
    n = orphan_embeddings(t["vec_chunks"], t["qa_chunks"]).count()
    rows.append(("orphan embeddings", n == 0, f"{n} rows", "doctor --fix" if n else ""))
    n = orphan_chunks(t["qa_chunks"], t["sessions"]).count()
    rows.append(("orphan chunks", n == 0, f"{n} rows", "doctor --fix" if n else ""))
    if dims is not None:
        n = t["vec_chunks"].filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dims).count()
        rows.append(("dimensions", n == 0, f"{n} embeddings of another length than {dims}", "rebuild" if n else ""))
    return spark.createDataFrame(rows, "name string, ok boolean, detail string, remedy string")


def first_user_turns(messages: DataFrame) -> DataFrame:
    """``(session_id, text)`` of each session's first user turn."""
    return messages.filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "msg_id").alias("text"))


def classify(sessions: DataFrame, messages: DataFrame, all_sessions: bool = False) -> DataFrame:
    """``(session_id, session_type, excerpt)`` for sessions that have no type, or
    for all; one without a user turn is interactive."""
    todo = sessions if all_sessions else sessions.filter("session_type is null")
    found = todo.select("session_id").join(first_user_turns(messages), "session_id", "left")
    return found.select("session_id", tx.classify_first_turn(F.col("text")).alias("session_type"), F.substring(F.coalesce("text", F.lit("")), 1, model.NOTE_CHARS).alias("excerpt"))


def reclassified(sessions: DataFrame, messages: DataFrame, all_sessions: bool = False) -> DataFrame:
    """The sessions with the types that ``classify`` finds."""
    found = classify(sessions, messages, all_sessions).select("session_id", F.col("session_type").alias("__type"))
    return sessions.join(found, "session_id", "left").withColumn("session_type", F.coalesce("__type", "session_type")).select(*sessions.columns)
