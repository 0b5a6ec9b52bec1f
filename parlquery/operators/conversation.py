"""Reading sessions: by prefix of their id, whole, or around a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx


def with_prefix(sessions: DataFrame, prefix: str) -> DataFrame:
    """Sessions whose id starts so, A-Z in either case; an exact id has no say."""
    return sessions.filter(tx.ascii_lower(F.col("session_id")).startswith(tx.fold(prefix)))


def resolve(sessions: DataFrame, prefix: str) -> str:
    """The one session id that a prefix names."""
    found = [r[0] for r in with_prefix(sessions, prefix).select("session_id").orderBy("session_id").limit(11).collect()]
    if not found:
        raise model.UsageError(f"no session starts with {prefix}", "search for it")
    if len(found) > 1:
        raise model.UsageError(f"{prefix} names more than one session", "give more of the id", found[:10])
    return found[0]


def ordered(messages: DataFrame, session_id: str) -> DataFrame:
    """A session's messages in order, long ones cut."""
    own = messages.filter(F.col("session_id") == session_id)
    return own.select("msg_id", "role", tx.cap_message(F.col("text")).alias("text")).orderBy("msg_id")


def window(messages: DataFrame, session_id: str, lo: int, hi: int, n: int = model.WINDOW_DEFAULT) -> DataFrame:
    """A session's messages from ``lo`` to ``hi`` with ``n`` neighbours on either
    side, counted within the session; nothing if none is between."""
    n = max(0, min(n, model.WINDOW_MOST))
    own = messages.filter(F.col("session_id") == session_id).select("msg_id", "role", tx.cap_message(F.col("text")).alias("text"))
    body = own.filter(F.col("msg_id").between(lo, hi))
    # two short lists instead of a numbering of the whole session
    before = own.filter(F.col("msg_id") < lo).orderBy(F.col("msg_id").desc()).limit(n)
    after = own.filter(F.col("msg_id") > hi).orderBy("msg_id").limit(n)
    some = body.agg(F.count("*").alias("c")).select("c").scalar()
    around = before.unionByName(after).filter(some > 0)
    return body.unionByName(around).orderBy("msg_id")


def around_chunk(messages: DataFrame, chunks: DataFrame, session_id: str, chunk_id: int, n: int = model.WINDOW_DEFAULT) -> DataFrame:
    """The window around a chunk; the chunk's own text where it has no range."""
    found = chunks.filter(F.col("chunk_id") == chunk_id).select("session_id", "content", "lo", "hi").limit(1).collect()
    if not found or found[0]["session_id"] != session_id:
        raise model.UsageError(f"chunk {chunk_id} is not of session {session_id}", "search again")
    if found[0]["lo"] is None:
        text = chunks.filter(F.col("chunk_id") == chunk_id)
        return text.select(F.lit(None).cast("bigint").alias("msg_id"), F.lit("chunk").alias("role"), tx.cap_message(F.col("content")).alias("text"))
    return window(messages, session_id, found[0]["lo"], found[0]["hi"], n)
