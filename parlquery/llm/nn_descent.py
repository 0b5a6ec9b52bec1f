"""Operator 5: near-duplicate embeddings by NN-descent.

Distinct vectors of a label are the nodes of a neighbour graph. Lists start from
the neighbours in a few random-projection orders and are refined by joining
neighbours of neighbours: each node compares the vectors in its list, forward
and reverse, with one another and hands the pairs that improve a list on. A list
that is saturated with links grows fourfold. Tight groups can fill even that with
their own vectors and keep no entry of a group next to them, so components of
saturated nodes are then compared exactly, wherever their centres and radii allow
a link, and joined. Links are counted in the end within whole components, block
against block. An audit compares a bounded sample of nodes, of those without and
with few and many links, with all others by brute force. While the share of a
node's links that was found is too low, another search with longer lists adds its
links; after the last one, all pairs of a space are compared.

Defined cases: vectors that are null, zero or hold a null or a number that is
not finite, and rows without a label or an id, link with nothing; equal vectors
of a label are links of one another; vectors of different lengths have no cosine
and are kept apart; very long vectors are compared whole; a cosine equal to the
threshold is a link; of equally near neighbours a list takes those with the
smaller ids; rows that repeat an id are one point with several vectors, which has
the links of all of them; extra columns are not read, whatever their names; an
empty table returns no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, components

COSINE = 0.93

#: Length of a neighbour list, random orders to start from, neighbours looked at
#: on one side of a row in each, and those kept from each.
LIST, ORDERS, WINDOW, FROM_ORDER = 10, 10, 8, 3

#: Rounds of refinement at most; they end when fewer entries than this share change.
ROUNDS, SETTLED = 5, 0.01

#: Nodes of the audit: without a link that was found, with less than ``LIST``
#: links, with more; the share that it asks for, and searches at most.
AUDIT, SHARE, SEARCHES = (2048, 256, 256), 0.98, 3

#: Vectors of a block in the last count.
BLOCK = 512

SEED = 7


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, one in a row."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, space, vec)`` of the rows that can link; a space is a label and
    a length, as a number, and ``vec`` the vector as bytes of doubles."""

    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for x in batch:
                v = x.as_py()
                a = None if not v or None in v else np.array(v, dtype="<f8")
                ok = a is not None and np.isfinite(a).all() and np.isfinite(n := np.linalg.norm(a)) and n > 0
                out.append(a.tobytes() if ok else None)
            yield pa.array(out, pa.binary())

    vec = F.arrow_udf(pack, "binary", F.ArrowUDFType.SCALAR_ITER)(F.col(embedding))
    rows = df.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), vec.alias("vec"))
    return rows.filter("vec is not null").select("vec_id", F.xxhash64("label", F.length("vec")).alias("space"), "vec")


def _starts(n: int, orders: int, seed: int):
    """The first neighbours: rows by bucket and place of several projections."""
    bits = max(0, min(16, round(math.log2(max(1, n / 256)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            size = np.array([len(v) // 8 for v in batch.column(2).to_pylist()])
            for dim in np.unique(size).tolist():
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((orders, bits + 1, dim))
                x = _matrix(part.column(2), dim)
                for o in range(orders):
                    y = x @ planes[dim][o].T
                    bucket = (y[:, :bits] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), dtype=np.int64)
                    at = pa.array(bucket.astype(np.int64) * 64 + o)
                    yield pa.RecordBatch.from_arrays([part.column(1), at, pa.array(y[:, bits]), part.column(0), part.column(2)], names=["space", "bucket", "place", "node", "vec"])

    return deal, "space bigint, bucket bigint, place double, node bigint, vec binary"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's best few of those next to it in its bucket."""
    for batch, spans in common.sorted_groups(batches, 2):
        a, b, s = [], [], []
        for i, j in spans:
            if j - i < 2:
                continue
            part = batch.slice(i, j - i)
            node = part.column(3).to_numpy()
            for lo in range(0, len(node), 4096):  # a long bucket in overlapping pieces
                x = _matrix(part.column(4).slice(lo, 4096 + WINDOW), len(part.column(4)[0].as_py()) // 8)
                m = len(x)
                sims = np.full((m, 2 * WINDOW), -2.0)
                for k in range(1, min(WINDOW, m - 1) + 1):
                    d = np.einsum("ij,ij->i", x[:-k], x[k:])
                    sims[:-k, k - 1] = d
                    sims[k:, WINDOW + k - 1] = d
                best = np.argsort(-sims, axis=1, kind="stable")[:, :FROM_ORDER]
                row, col = np.repeat(np.arange(m), best.shape[1]), best.ravel()
                sim = sims[row, col]
                ok = sim > -2
                to = row + np.where(col < WINDOW, col + 1, WINDOW - 1 - col)
                a.append(node[lo + row[ok]])
                b.append(node[lo + to[ok]])
                s.append(sim[ok])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], names=["a", "b", "sim"])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one node compared with one another; the pairs that would
    enter a list: rows (node, neighbour, worst entry of its list, vector)."""
    for batch, spans in common.sorted_groups(batches, 1):
        dim = len(batch.column(3)[0].as_py()) // 8
        sizes = {len(v) for v in batch.column(3).to_pylist()}
        x = _matrix(batch.column(3), dim) if len(sizes) == 1 else None
        ids, worst = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        a, b, s = [], [], []
        for i, j in spans:
            if j - i < 2:
                continue
            y = x[i:j] if x is not None else _matrix(batch.column(3).slice(i, j - i), len(batch.column(3)[i].as_py()) // 8)
            sim = y @ y.T
            np.fill_diagonal(sim, -2)
            p, q = np.nonzero(sim > worst[i:j, None])
            a.append(ids[i + p])
            b.append(ids[i + q])
            s.append(sim[p, q])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x_)) for x_ in (a, b, s)], names=["a", "b", "sim"])


def _best(pairs: DataFrame, size: int, cosine: float) -> DataFrame:
    """Lists: the best ``size`` of each node, up to four times as many links."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return once.withColumn("r", rank).filter((F.col("r") <= size) | ((F.col("r") <= 4 * size) & (F.col("sim") >= cosine)))


def descend(own: DataFrame, size: int, orders: int, cosine: float = COSINE, seed: int = SEED) -> DataFrame:
    """``(a, b, sim)``: the neighbour lists of all nodes."""
    deal, schema = _starts(own.count(), orders, seed)
    dealt = own.select("node", "space", "vec").mapInArrow(deal, schema)
    dealt = dealt.repartition("space", "bucket").sortWithinPartitions("space", "bucket", "place", "node")
    lists = common.materialize(_best(dealt.mapInArrow(_neighbours, "a bigint, b bigint, sim double"), size, cosine), "lists")
    for _ in range(ROUNDS):
        worst = lists.groupBy("a").agg(F.min("sim").alias("w"), F.count("*").alias("n"))
        worst = worst.select(F.col("a").alias("u"), F.when(F.col("n") >= size, F.col("w")).otherwise(-2.0).alias("w"))
        both = lists.select("a", "b", "r").unionAll(lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
        # of a list and of those that list the node, the best entries take part
        part = F.row_number().over(Window.partitionBy("a").orderBy("r", "b"))
        both = both.groupBy("a", "b").agg(F.min("r").alias("r")).withColumn("p", part).filter(F.col("p") <= 2 * size)
        rows = both.select("a", "b").join(worst, F.col("b") == F.col("u")).drop("u").join(own.select(F.col("node").alias("u"), "vec"), F.col("b") == F.col("u"))
        rows = rows.select(F.col("a").alias("v"), "b", "w", "vec").repartition("v").sortWithinPartitions("v")
        found = rows.mapInArrow(_join, "a bigint, b bigint, sim double")
        new = common.materialize(_best(lists.select("a", "b", "sim").unionAll(found), size, cosine), "lists")
        fresh = new.join(lists, ["a", "b"], "left_anti").count()
        total = new.count()
        common.discard(lists)
        lists = new
        if fresh <= SETTLED * total:
            break
    out = lists.select("a", "b", "sim")
    out._written_at = lists._written_at
    return out


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean direction of each block, and the widest angle from it."""
    for batch, spans in common.sorted_groups(batches, 2):
        first = batch.take(pa.array([i for i, _ in spans]))
        centre, radius = [], []
        for i, j in spans:
            x = _matrix(batch.column(4).slice(i, j - i), len(batch.column(4)[i].as_py()) // 8)
            c = x.sum(0)
            c = c / n if (n := np.linalg.norm(c)) > 1e-6 else x[0]
            centre.append(c.astype("<f8").tobytes())
            radius.append(float(np.arccos(np.clip((x @ c).min(), -1, 1))))
        yield pa.RecordBatch.from_arrays([first.column(0), first.column(1), first.column(2), pa.array(radius), pa.array(centre, pa.binary())], names=["component", "own", "space", "radius", "centre"])


def _within_reach(cosine: float):
    """Pairs of blocks of two components that may hold a link, by the triangle
    inequality of angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in common.sorted_groups(batches, 3):
            tile, component, own, radius = (batch.column(k).to_numpy() for k in (3, 4, 5, 6))
            pick = []
            for i, j in spans:
                x = _matrix(batch.column(7).slice(i, j - i), len(batch.column(7)[i].as_py()) // 8)
                lo, hi = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                first, second = np.flatnonzero(tile[i:j] == lo), np.flatnonzero(tile[i:j] == hi)
                reach = math.acos(cosine) + 1e-6 + radius[i + first][:, None] + radius[i + second][None, :]
                near = np.arccos(np.clip(x[first] @ x[second].T, -1, 1)) <= reach
                near &= component[i + first][:, None] != component[i + second][None, :]
                if lo == hi:
                    near = np.triu(near)
                p, q = np.nonzero(near)
                pick.append((i + first[p], i + second[q]))
            p, q = (np.concatenate(x) for x in zip(*pick, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (component[p], own[p], component[q], own[q])], names=["ca", "oa", "cb", "ob"])

    return run


def _linked(cosine: float):
    """Of pairs of blocks, those that a link crosses: rows (component, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in common.sorted_groups(batches, 4):
            left, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 0, 2))
            at = []
            for i, j in spans:
                x = _matrix(batch.column(5).slice(i, j - i), len(batch.column(5)[i].as_py()) // 8)
                if (x[left[i:j] == 0] @ x[left[i:j] == 1].T >= cosine).any():
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at])], names=["a", "b"])

    return run


def joined(own: DataFrame, near: DataFrame, groups: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``groups`` with those made one that a link between saturated nodes joins,
    nodes of at least ``LIST`` links; lists of fewer were cut by no limit."""
    full = near.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") >= LIST).select("node")
    full = full.join(groups, "node")
    size = full.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("blocks"))
    full = full.join(size, "component").join(own.select("node", "space", "vec"), "node")
    full = full.select("component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("bigint").alias("own"), "space", "node", "vec")
    full = common.materialize(full, "full")
    centres = full.repartition("component", "own").sortWithinPartitions("component", "own", "node")
    centres = centres.mapInArrow(_centres, "component bigint, own bigint, space bigint, radius double, centre binary")
    centres = common.materialize(centres, "centres")
    tiles = centres.groupBy("space").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("tiles"))
    rows = centres.join(tiles, "space").withColumn("tile", F.pmod(F.xxhash64("component", "own"), F.col("tiles")).cast("bigint"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    rows = rows.select("space", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "component", "own", "radius", "centre")
    rows = rows.repartition("space", "lo", "hi").sortWithinPartitions("space", "lo", "hi", "component", "own")
    pairs = rows.mapInArrow(_within_reach(cosine), "ca bigint, oa bigint, cb bigint, ob bigint")
    pairs = common.materialize(pairs, "pairs")
    sides = [pairs.withColumns({"component": F.col(c), "own": F.col(o), "side": F.lit(k)}) for k, (c, o) in enumerate([("ca", "oa"), ("cb", "ob")])]
    both = sides[0].unionAll(sides[1]).join(full.select("component", "own", "vec"), ["component", "own"])
    both = both.select("ca", "oa", "cb", "ob", "side", "vec").repartition("ca", "oa", "cb", "ob").sortWithinPartitions("ca", "oa", "cb", "ob", "side")
    found = common.materialize(both.mapInArrow(_linked(cosine), "a bigint, b bigint").distinct(), "bridges")
    common.discard(full, centres, pairs)
    if found.isEmpty():
        return groups
    to = components.components(found).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return groups.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def _count(cosine: float):
    """Links of each node within a component, from pairs of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in common.sorted_groups(batches, 3):
            block, node, copies = (batch.column(k).to_numpy() for k in (3, 4, 5))
            ids, n = [], []
            for i, j in spans:
                x = _matrix(batch.column(6).slice(i, j - i), len(batch.column(6)[i].as_py()) // 8)
                lo, hi = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                own, c = block[i:j], copies[i:j]
                first, second = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
                near = x[first] @ x[second].T >= cosine
                if lo == hi:
                    np.fill_diagonal(near, False)
                ids.append(node[i + first])
                n.append(near @ c[second])
                if lo != hi:
                    ids.append(node[i + second])
                    n.append(near.T @ c[first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(n).astype(np.int64))], names=["node", "n"])

    return run


def _blocks(own: DataFrame, groups: DataFrame) -> DataFrame:
    """Every pair of a component's blocks, as the rows of both, in order."""
    size = groups.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("blocks"))
    rows = groups.join(size, "component").join(own, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("bigint"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "copies", "vec")
    return rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "node")


def links(own: DataFrame, groups: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(node, n)``: links of every node to others of its component, copies of
    other vectors counted, by comparing the component's blocks two by two."""
    return _blocks(own, groups).mapInArrow(_count(cosine), "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect all that ``near`` connects."""
    rows, cols = near.any(1), np.ones(near.shape[1], dtype=bool)
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while rows.any():
        front = np.array([rows.argmax()])
        rows[front] = False
        while len(front):
            new = np.flatnonzero(near[front].any(0) & cols)
            if not len(new):
                break
            cols[new] = False
            a.append(front[near[np.ix_(front, new)].argmax(0)])
            b.append(new)
            front = np.flatnonzero(near[:, new].any(1) & rows)
            rows[front] = False
            a.append(front)
            b.append(new[near[np.ix_(front, new)].argmax(1)])
    return np.concatenate(a), np.concatenate(b)


def exact(own: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(a, b)``: links that connect all that links connect, by all pairs of a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in common.sorted_groups(batches, 3):
            block, node = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            a, b = [], []
            for i, j in spans:
                x = _matrix(batch.column(6).slice(i, j - i), len(batch.column(6)[i].as_py()) // 8)
                first, second = (np.flatnonzero(block[i:j] == batch.column(k)[i].as_py()) for k in (1, 2))
                near = x[first] @ x[second].T >= cosine
                if batch.column(1)[i].as_py() == batch.column(2)[i].as_py():
                    np.fill_diagonal(near, False)
                p, q = _forest(near)
                a.append(node[i + first[p]])
                b.append(node[i + second[q]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    whole = own.select("node", F.col("space").alias("component"))
    return _blocks(own, whole).mapInArrow(run, "a bigint, b bigint")


def audit(own: DataFrame, counted: DataFrame, cosine: float = COSINE) -> float:
    """Mean share of the links of a node that was found, over the nodes that have
    links, from bounded samples of nodes by the links found, against all by brute force."""
    found = own.join(counted, "node", "left").select("node", "space", "vec", F.coalesce("n", F.lit(0)).alias("n"))
    found = found.withColumn("class", F.when(F.col("n") == 0, 0).when(F.col("n") < LIST, 1).otherwise(2))
    size = {r["class"]: r["count"] for r in found.groupBy("class").count().collect()}
    asked = []
    for c, most in enumerate(AUDIT):
        if c in size:
            asked += found.filter(F.col("class") == c).orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(most).collect()
    shared = own.sparkSession.sparkContext.broadcast([(r["node"], r["space"], bytes(r["vec"])) for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        parts: dict[int, list[int]] = {}
        for k, q in enumerate(shared.value):
            parts.setdefault(q[1], []).append(k)
        nodes_ = np.array([q[0] for q in shared.value], dtype=np.int64)
        matrix = {s: _matrix(pa.array([shared.value[k][2] for k in ks]), len(shared.value[ks[0]][2]) // 8) for s, ks in parts.items()}
        for batch in batches:
            node, space, copies = (batch.column(k).to_numpy() for k in (0, 1, 3))
            for s in np.unique(space).tolist():
                if s not in parts:
                    continue
                every = np.flatnonzero(space == s)
                for lo in range(0, len(every), 1024):
                    at = every[lo : lo + 1024]
                    x = _matrix(batch.column(2).take(pa.array(at)), matrix[s].shape[1])
                    near = (matrix[s] @ x.T >= cosine) & (nodes_[parts[s]][:, None] != node[at][None, :])
                    total[parts[s]] += near @ copies[at]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    true = own.select("node", "space", "vec", "copies").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    true = {r["k"]: r["n"] for r in true.collect()}  # one of each node asked
    have = linked = 0.0
    for c, n in size.items():
        of = [k for k, r in enumerate(asked) if r["class"] == c]
        have += n / len(of) * sum(min(1.0, asked[k]["n"] / true[k]) for k in of if k in true)
        linked += n / len(of) * sum(k in true for k in of)
    return have / linked if linked else 1.0


def cluster(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    return audited(df, vec_id, embedding, label, cosine)[0]


def audited(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE) -> tuple[DataFrame, float]:
    """The rows of ``cluster``, and the share of links found that the audit of the
    search behind them gave; 1 where all pairs were compared."""
    rows = common.materialize(nodes(df, vec_id, embedding, label), "vectors")
    # equal vectors are one node, with the number of its copies
    own = rows.groupBy("space", "vec").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    own = common.materialize(own, "nodes")
    size, orders, near, share = LIST, ORDERS, None, 0.0
    for search in range(SEARCHES):
        lists = descend(own, size, orders, cosine, SEED + search)
        more = lists.filter(F.col("sim") >= cosine).select("a", "b")
        before, near = near, common.materialize(more if near is None else near.unionAll(more).distinct(), "near")
        parts = components.components(near)
        groups = common.materialize(joined(own, near, parts, cosine), "groups")
        counted = common.materialize(links(own, groups, cosine), "counted")
        common.discard(lists, parts, *([before] if before is not None else []))
        share = audit(own, counted, cosine)
        if share >= SHARE:
            break
        common.discard(groups, counted)
        size, orders = 2 * size, min(60, 2 * orders)
    else:
        groups = common.materialize(components.components(exact(own, cosine)), "groups")
        counted, share = common.materialize(links(own, groups, cosine), "counted"), 1.0
    common.discard(near)
    named = own.join(groups, "node", "left").join(counted, "node", "left")
    named = named.select("space", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = rows.join(named, ["space", "vec"]).select(F.col("vec_id").alias("__id"), "n_links", "component_id")
    linked = linked.groupBy("__id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = df.select(F.col(vec_id).alias("vec_id")).join(linked, F.col("vec_id") == F.col("__id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")), share


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5``: links and components of all embeddings."""
    return cluster(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
