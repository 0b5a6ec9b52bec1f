"""Operator 6: mixing sources to target weights by a splitting tree.

Sources weigh 1, 2, 3, repeating, in the order of their names, and share the
words of the whole table; a target stops at ``MOST`` times its source's words
and what is above is shared again by weight. Each source is dealt into blocks by
a keyed hash of its rows. The mix takes a source in whole passes and a last pass
up to a cut, which a histogram over blocks and then the rows of one block place
exactly. That gives every source a quota of blocks. A tree splits the quotas
among the output shards: at each node the left half draws its blocks from the
sources by a multivariate hypergeometric, so that all leaves together hold the
exact quotas. A source's blocks are permuted, and a leaf takes the range that
its draws say; a row is taken as often as leaves took its block. Within a shard,
rows of all its blocks are in an order of their own hashes.

There may be ``SOURCES`` sources; more raise an error. Blocks and shards get
larger beyond ``BLOCKS`` blocks and ``LEAF_CELLS`` cells, which changes neither
quotas nor what is taken of a row, only what stands together.

Defined cases: a null text has no words; a null source is one of its own, the
last; a table without words has targets of zero; rows that are repeated as a
whole at the cut share what is left equally; very long texts are counted whole
and belong to one block; rows whose hashes tie are ordered by their ids; extra
columns stay, whatever their names; an empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .feistel import permute

#: Times its own words that a source may be taken.
MOST = 3

#: Words of a block at least, blocks of the whole table at about most (blocks get
#: larger beyond it, so that no step holds more numbers of one source), blocks
#: of a shard, and what decides all draws.
BLOCK_WORDS = 1 << 16
BLOCKS = 1 << 20
SHARD_BLOCKS = 256
SEED = 20_240

#: Cells (sources times shards) of the tree's leaves at most; beyond it shards
#: get larger, so that what is broadcast stays within 8 bytes times this.
LEAF_CELLS = SOURCES = 1 << 20


def words(text: str = "text") -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def order(doc_id: str = "doc_id", size: str = "size", seed: int = SEED) -> Column:
    """A row's place in its source's permutation, from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(size)), 1)


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, rank, weight, target)`` of every source.

    In the order of cap over weight, a source is capped if its share of what
    the ones before it leave over reaches its cap; the others share the rest."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("rank", rank).withColumn("weight", 1 + (F.col("rank") - 1) % 3)
    cap = MOST * F.col("source_size")
    before = Window.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    by = by.withColumn("cap", cap).withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    by = by.withColumns({"all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    share = (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    by = by.withColumn("capped", F.col("cap") <= F.col("weight") * share)
    open_ = ~F.col("capped")
    level = (F.col("all_size") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))) / F.sum(F.when(open_, F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * level, F.col("cap").cast("double")))
    return by.withColumn("target", target.cast("double")).select("source", "source_size", F.col("rank").alias("sid"), "weight", "target")


def plan(sizes: DataFrame) -> DataFrame:
    """Per source: its target, whole passes, blocks, and where the last pass is
    cut (``cut``: the place; ``part``: words of each row there)."""
    quota = F.floor(F.col("target") + 0.5).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("int")
    by = targets(sizes).withColumn("quota", quota).withColumn("passes", passes)
    by = by.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    words_of_block = F.greatest(F.lit(BLOCK_WORDS), F.ceil(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / BLOCKS))
    by = by.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / words_of_block)).cast("bigint"))
    by = common.materialize(by, "mix-sources")
    rows = sizes.join(by.filter("rest > 0").select(F.col("source").alias("s"), "sid", "blocks", "rest"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("block", block())
    upto = Window.partitionBy("sid").orderBy("block")
    sums = rows.groupBy("sid", "rest", "block").agg(F.sum("size").alias("w"))
    crossed = sums.withColumn("upto", F.sum("w").over(upto)).filter("upto >= rest and upto - w < rest").select(F.col("sid").alias("cs"), F.col("block").alias("cb"), (F.col("rest") - F.col("upto") + F.col("w")).alias("left"))
    # one block of each source: its rows one by one
    inside = rows.join(crossed, (F.col("sid") == F.col("cs")) & (F.col("block") == F.col("cb"))).groupBy("sid", "left", "place").agg(F.sum("size").alias("w"), F.count("*").alias("m"))
    upto = Window.partitionBy("sid").orderBy("place")
    cut = inside.withColumn("upto", F.sum("w").over(upto)).filter("upto >= left and upto - w < left")
    cut = cut.select(F.col("sid").alias("k"), F.col("place").alias("cut"), F.floor((F.col("left") - F.col("upto") + F.col("w")) / F.col("m")).cast("bigint").alias("part"))
    out = by.join(cut, F.col("sid") == F.col("k"), "left").drop("k")
    last = F.when(F.col("cut").isNotNull(), block("cut") + 1).otherwise(0)
    out = common.materialize(out.withColumn("quota_blocks", F.col("passes") * F.col("blocks") + last), "mix-plan")
    common.discard(by)
    return out


def block(place: str = "place") -> Column:
    """The block of a place; monotone, so that blocks are ranges of places."""
    return F.least(F.floor(F.col(place) / F.lit(float(1 << 63)) * F.col("blocks")), F.col("blocks") - 1).cast("bigint")


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks by shard and source: the leaves of the splitting tree."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[a] = q
            continue
        mid = (a + b) // 2
        total = int(q.sum())
        take = total * (mid - a) // (b - a)
        rng = np.random.default_rng([seed, a, b])
        left = np.zeros_like(q)
        drawn, remaining = 0, total
        for i, n in enumerate(q.tolist()):  # one marginal after the other
            want = take - drawn
            if n and want:
                left[i] = rng.hypergeometric(n, remaining - n, want) if remaining > n else want
                drawn += int(left[i])
            remaining -= n
        todo += [(a, mid, left), (mid, b, q - left)]
    return out


class Leaves:
    """The tree's leaves: upper ends of each shard's range of a source's permuted
    blocks, and the quotas."""

    def __init__(self, quotas: np.ndarray, seed: int = SEED):
        self.quotas, self.seed = quotas, seed
        self.shards = int(max(1, min(-(-int(quotas.sum()) // SHARD_BLOCKS), LEAF_CELLS // max(1, len(quotas)))))
        self.ends = np.cumsum(split(quotas, self.shards, seed), axis=0)

    @classmethod
    def of(cls, plan_: DataFrame, seed: int = SEED) -> Leaves:
        rows = plan_.select("sid", "quota_blocks").orderBy("sid").limit(SOURCES + 1).collect()  # SOURCES at most
        if len(rows) > SOURCES:
            raise ValueError(f"more than {SOURCES} sources")
        return cls(np.array([r[1] for r in rows], dtype=np.int64), seed)

    def shard(self, sid: int, draws: np.ndarray) -> np.ndarray:
        """The shards that take draws (pass times blocks, and block) of a source."""
        to = permute(draws, int(self.quotas[sid - 1]), self.seed * 1009 + sid)
        return np.searchsorted(self.ends[:, sid - 1], to, side="right")


def cells(leaves: Leaves, spark: SparkSession) -> Column:
    """The passes that take a row's block, with the shards that they go to."""
    shared = spark.sparkContext.broadcast(leaves)  # LEAF_CELLS and SOURCES numbers at most
    kind = pa.list_(pa.struct([("pass", pa.int32()), ("shard", pa.int64())]))

    def place(batches: Iterator[pa.StructArray]) -> Iterator[pa.Array]:
        leaves = shared.value
        for batch in batches:
            sid, own, blocks, quota = (batch.field(k).to_numpy() for k in range(4))
            # passes: every draw below the quota that leads to the block
            times = np.maximum(0, -(-(quota - own) // blocks))
            row = np.repeat(np.arange(len(sid)), times)
            which = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            draw, shard = which * blocks[row] + own[row], np.zeros(len(row), dtype=np.int64)
            for s in np.unique(sid[row]).tolist():
                at = np.flatnonzero(sid[row] == s)
                shard[at] = leaves.shard(s, draw[at])
            items = pa.StructArray.from_arrays([pa.array(which.astype(np.int32)), pa.array(shard)], fields=list(kind.value_type))
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)).astype(np.int32)), items)

    f = F.arrow_udf(place, "array<struct<pass: int, shard: bigint>>", F.ArrowUDFType.SCALAR_ITER)
    return f(F.struct("sid", "block", "blocks", "quota_blocks"))


def decide(rows: DataFrame, plan_: DataFrame) -> DataFrame:
    """Add to rows with source, size and place what the plan says of their source,
    their block, the words of the last pass, and the cells that take the block."""
    own = plan_.select(F.col("source").alias("own_source"), F.col("sid").cast("bigint").alias("sid"), "source_size", "target", "passes", "blocks", "quota_blocks", "cut", "part")
    last = F.when(F.col("place") < F.col("cut"), F.col("size")).when(F.col("place") == F.col("cut"), F.least("size", "part")).otherwise(0)
    out = rows.join(own, F.col("source").eqNullSafe(F.col("own_source"))).drop("own_source").withColumn("block", block())
    return out.withColumn("last", last).withColumn("cells", cells(Leaves.of(plan_), rows.sparkSession))


def sized(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, source, size, place)`` of every row, written once."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))
    return common.materialize(rows.withColumn("place", order()), "mix-sizes")


def mix(sizes: DataFrame) -> DataFrame:
    """Every row with its words, its source's words and target, the words that
    the mix takes, and the shards that its passes go to."""
    out = decide(sizes, plan(sizes))
    # the block of the cut is taken, but of its rows not all
    whole = F.filter("cells", lambda c: (c["pass"] < F.col("passes")) | (F.col("last") > 0))
    words_of = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + F.when(c["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("last")))
    return out.withColumn("cells", whole).withColumn("taken", words_of)


def dealt(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(shard, slot, row)``: the rows of ``df`` (as structs), each as often as
    the mix takes it, dealt out by shard and in the order of slots within each.
    Rows at a cut are taken whole if half of their words or more is to be, else
    not at all."""
    sizes = sized(df, doc_id, source, text)
    plan_ = plan(sizes)
    common.discard(sizes)
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))
    rows = decide(rows.withColumn("place", order()), plan_)
    half = F.when(F.col("place") < F.col("cut"), F.col("size") > 0).otherwise((F.col("last") > 0) & (2 * F.col("part") >= F.col("size")))
    taken = F.filter("cells", lambda c: (c["pass"] < F.col("passes")) | half)
    rows = rows.select("row", "sid", "block", "doc_id", "size", F.explode(taken).alias("c"))
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "c.shard", "sid", "block", "c.pass", "doc_id", "size"), 1)
    rows = rows.select(F.col("c.shard").alias("shard"), slot.alias("slot"), "doc_id", "row")
    # a shard is cut into ranges of slots, as many as the session wants tasks
    shards = Leaves.of(plan_).shards
    pieces = max(1, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    piece = F.least(F.floor(F.col("slot") / F.lit(float(1 << 63)) * pieces), F.lit(pieces - 1))
    rows = rows.repartitionById(shards * pieces, (F.col("shard") * pieces + piece).cast("int"))
    return rows.sortWithinPartitions("shard", "slot", "doc_id").select("shard", "slot", "row")


def mixed(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, shard after shard."""
    return dealt(df, doc_id, source, text).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op6``: the mix of all documents."""
    done = mix(sized(common.table(spark, sf_dir, "documents", "doc_id", "source", "text")))
    return done.select("doc_id", "size", "source_size", "target", "taken", F.col("cells.shard").alias("shards"))
