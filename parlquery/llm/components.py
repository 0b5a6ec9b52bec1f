"""Connected components by alternating star contraction over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``, where the
    component is the smallest node that links lead to.

    Every round replaces edges by stars: first each node's larger neighbours
    hang on its smallest one, then its smaller ones do. Hubs are aggregated map
    side (a minimum), so that no task gathers the neighbours of a node, and the
    number of rounds grows with the logarithm of the longest chain."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, was = common.materialize(now, name), None
    for _ in range(most):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written, so that both sides of a join are dealt out
        # afresh and Spark can split the partition of a hub
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        least = common.materialize(least.select("n", F.least("n", "m").alias("m")), name)
        # large star: neighbours above a node go to the least around it
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = common.materialize(large.filter("a <> b").distinct(), name)
        # small star: neighbours below a node go to the least of them
        low = common.materialize(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), name)
        small = large.join(low, F.col("a") == F.col("n"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        new = common.materialize(small.select(F.explode(ends).alias("e")).select("e.a", "e.b").filter("a <> b").distinct(), name)
        for old in (now, least, large, low):
            common.discard(old)
        now = new
        # stars stay as they are: nothing more to do
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == was:
            break
        was = state
    else:
        raise RuntimeError("components did not settle")
    centre = now.select(F.col("b").alias("node")).distinct()
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(centre.select("node", F.col("node").alias("component")))
    out._written_at = now._written_at
    return out
