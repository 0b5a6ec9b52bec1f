"""Semantic search: exact nearest neighbours and the nearest chunk of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions.vector import l2


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``(chunk_id, sub_idx, distance)`` of the ``k`` nearest embeddings."""
    rows = vectors.filter("embedding is not null").select("chunk_id", "sub_idx", l2(F.col("embedding"), query).alias("distance"))
    return rows.orderBy(F.round("distance", 9), "chunk_id", "sub_idx").limit(k)


def nearest_sessions(vectors: DataFrame, chunks: DataFrame, allowed: DataFrame, query: list[float], limit: int, prefilter: bool = False) -> DataFrame:
    """``(session_id, distance, chunk_id)``: the nearest chunk of each session
    among the nearest embeddings. Filters apply after the limit by default, so
    that a narrow filter may leave fewer; ``prefilter`` applies them before."""
    own = chunks.select("chunk_id", "session_id").join(allowed, "session_id", "left_semi")
    if prefilter:
        vectors = vectors.join(own.select("chunk_id"), "chunk_id", "left_semi")
    near = nearest(vectors, query, model.OVERSAMPLE * limit)
    hits = near.join(own, "chunk_id").groupBy("session_id").agg(F.min(F.struct("distance", "chunk_id")).alias("b"))
    return hits.select("session_id", "b.distance", "b.chunk_id")
