"""What a hit shows: the chunk that owns its best message, or a snippet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def by_range(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(session_id, content, chunk_id)`` where exactly one chunk's range holds
    the hit's best message (``msg_id``)."""
    own = chunks.filter("lo is not null").select("session_id", "lo", "hi", "content", "chunk_id")
    found = hits.select("session_id", "msg_id").join(own, "session_id").filter("msg_id between lo and hi")
    return _only(found)


def by_substring(hits: DataFrame, messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(session_id, content)`` where exactly one chunk without a range holds
    the text of the hit's best message."""
    said = hits.select("session_id", "msg_id").join(messages.select("msg_id", "text"), "msg_id")
    own = chunks.filter("lo is null").select("session_id", "content", "chunk_id")
    found = said.join(own, "session_id").filter(F.col("content").contains(F.col("text")))
    return _only(found).drop("chunk_id")


def _only(found: DataFrame) -> DataFrame:
    one = found.groupBy("session_id").agg(F.count("*").alias("n"), F.max("content").alias("content"), F.max("chunk_id").alias("chunk_id"))
    return one.filter("n = 1").drop("n")


def by_snippet(hits: DataFrame, messages: DataFrame, matched: DataFrame, terms: list[str]) -> DataFrame:
    """``(session_id, content)``: a window of the first matching message."""
    first = matched.join(hits.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.min("msg_id").alias("msg_id"))
    said = first.join(messages.select("msg_id", "text"), "msg_id")
    return said.select("session_id", tx.snippet(F.col("text"), terms).alias("content"))


def by_vector(near: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(session_id, content, chunk_id)`` of the nearest chunk."""
    return near.select("session_id", "chunk_id").join(chunks.select("chunk_id", "content"), "chunk_id").select("session_id", "content", "chunk_id")


def attach(hits: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """Add ``excerpt`` and ``chunk_id``: of each hit the first tier that has it.
    Hits are a page of results, so the joins are small whatever the tables are."""
    texts, ids, out = [], [], hits
    for k, tier in enumerate(tiers):
        has_id = "chunk_id" in tier.columns
        own = tier.select(F.col("session_id").alias(f"s{k}"), F.col("content").alias(f"t{k}"), (F.col("chunk_id") if has_id else F.lit(None).cast("bigint")).alias(f"i{k}"))
        out = out.join(own, F.col("session_id") == F.col(f"s{k}"), "left")
        texts.append(F.col(f"t{k}"))
        ids.append((F.col(f"t{k}"), F.col(f"i{k}")))
    chunk = F.lit(None).cast("bigint")
    for t, i in reversed(ids):
        chunk = F.when(t.isNotNull(), i).otherwise(chunk)
    return out.select(*[hits[c] for c in hits.columns], F.coalesce(*texts, F.lit("")).alias("excerpt"), chunk.alias("chunk_id"))
