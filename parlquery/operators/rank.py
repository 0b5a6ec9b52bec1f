"""Fusion and recency. Legs hold at most a few hundred rows when they get here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions.time import boosted


def positions(leg: DataFrame, by: str) -> DataFrame:
    """``(session_id, pos)``, from 0."""
    order = Window.orderBy(F.round(by, 9), "session_id")
    return leg.select("session_id", (F.row_number().over(order) - 1).alias("pos"))


def fuse(fts: DataFrame, vec: DataFrame) -> DataFrame:
    """``(session_id, score)`` by reciprocal ranks of both legs."""
    both = positions(fts, "rank").unionByName(positions(vec, "distance"))
    return both.groupBy("session_id").agg(F.sum(1.0 / (model.RRF_K + F.col("pos"))).alias("score"))


def by_score(hits: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Fused hits, newer ones up, best first."""
    out = hits.withColumn("score", boosted(F.col("score"), F.col("timestamp_ms"), now_ms))
    return out.orderBy(F.round("score", 9).desc(), "session_id").limit(limit)


def by_rank(hits: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Keyword hits, whose ranks are negative: the boost makes them smaller."""
    out = hits.withColumn("rank", boosted(F.col("rank"), F.col("timestamp_ms"), now_ms))
    return out.orderBy(F.round("rank", 9), "session_id").limit(limit)


def newest(hits: DataFrame, limit: int) -> DataFrame:
    return hits.orderBy(F.col("timestamp_ms").desc_nulls_last(), "session_id").limit(limit)
