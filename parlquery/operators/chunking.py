"""Questions with their answers as chunks for search and embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text as tx
from .numbering import dense_ids, running_max

#: Messages of a block of a session, and blocks that chunks are numbered in.
BLOCK = 1024
ID_BLOCKS = 1 << 16


def groups(messages: DataFrame) -> DataFrame:
    """``(session_id, lo, hi, user, assistant)``: each user turn with the run of
    answers right after it. An empty user turn goes with its answers, and so do
    answers without a question; empty answers only move ``hi``."""
    known = messages.filter(F.col("role").isin(*model.ROLES)).select("session_id", "msg_id", "role", "text")
    user = F.col("role") == "user"
    opened = running_max(known, F.when(user, F.col("msg_id")), "lo", "session_id", "msg_id", F.floor(F.col("msg_id") / BLOCK)).filter("lo is not null")
    answer = F.when(~user & (F.col("text") != ""), F.struct("msg_id", "text"))
    out = opened.groupBy("session_id", "lo").agg(
        F.max("msg_id").alias("hi"), F.max(F.when(user, F.col("text"))).alias("user"), F.array_sort(F.collect_list(answer)).alias("answers")
    )
    joined = F.when(F.size("answers") > 0, F.array_join(F.transform("answers", lambda a: a["text"]), "\n"))
    return out.filter("user <> ''").select("session_id", "lo", "hi", "user", joined.alias("assistant"))


def chunks(messages: DataFrame, most: int = model.CHUNK_BYTES) -> DataFrame:
    """``(session_id, lo, hi, part, content)``, contents of ``most`` bytes at most."""
    found = groups(messages)
    return found.select("session_id", "lo", "hi", F.posexplode(tx.contents(F.col("user"), F.col("assistant"), most)).alias("part", "content"))


def numbered(found: DataFrame, messages: DataFrame, first: Column | int = 0) -> DataFrame:
    """Add ``chunk_id`` to chunks of these messages, counted on from ``first`` in
    the order of messages. Blocks are ranges of ids, as many at any size."""
    width = messages.agg(F.greatest(F.lit(1), F.ceil(F.max("msg_id") / ID_BLOCKS)).alias("w")).select("w").scalar()
    out = dense_ids(found, "chunk_id", ["lo", "part"], F.floor(F.col("lo") / width))
    return out.withColumn("chunk_id", F.col("chunk_id") + (F.lit(first) if isinstance(first, int) else first))


def unchunked(sessions: DataFrame, chunked: DataFrame) -> DataFrame:
    """Sessions without a chunk."""
    return sessions.join(chunked.select("session_id"), "session_id", "left_anti")


def backfill_ranges(chunked: DataFrame, messages: DataFrame) -> DataFrame:
    """``(chunk_id, lo, hi)`` of chunks without a range, from chunking their
    sessions anew: only where a session's chunks are the same, one by one."""
    bare = chunked.join(chunked.filter("lo is null").select("session_id").distinct(), "session_id", "left_semi")
    again = chunks(messages.join(bare.select("session_id").distinct(), "session_id", "left_semi"))
    old = bare.select("session_id", "chunk_id", F.col("content").alias("old"), (F.col("lo").isNull()).alias("bare"), F.row_number().over(Window.partitionBy("session_id").orderBy("chunk_id")).alias("k"))
    new = again.select("session_id", "lo", "hi", F.col("content").alias("new"), F.row_number().over(Window.partitionBy("session_id").orderBy("lo", "part")).alias("k"))
    both = old.join(new, ["session_id", "k"], "full_outer")
    same = both.groupBy("session_id").agg(F.every(F.coalesce(F.col("old") == F.col("new"), F.lit(False))).alias("same")).filter("same")
    return both.join(same, "session_id", "left_semi").filter("bare").select("chunk_id", "lo", "hi")
