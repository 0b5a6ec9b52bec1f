"""Operator 3: near-duplicates by SimHash with deletion-variant signatures.

Fingerprints of 64 bits link at up to 4 differing bits. Cut into three segments,
two linked fingerprints have a segment in which they differ by one bit at most.
Every segment is indexed under each of its one-wildcard variants (the segment
with one bit blanked), an equality join of variants brings the candidates
together, and a full comparison verifies them. Only distinct fingerprints are
indexed, so copies cost nothing however many there are, and a task reports stars
that connect what it found near, at most one row a fingerprint, not pairs.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle has make one shingle; repeated rows share a
component, and one of them stays; rows without an id are compared like others,
have no say in the smallest id, and one of them stays where a group has no id at
all; an empty table returns no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components

SHINGLE = 4
DISTANCE = 4

#: Bits of the three segments, from the lowest.
SEGMENTS = (22, 21, 21)

#: Members up to which buckets are compared many at once, by distance in order.
SMALL = 32


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as an unsigned number."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        h = xxhash.xxh64_intdigest
        starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        hashes = [h(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    every = np.array(hashes, dtype=np.uint64)
    for k in range(0, len(every), 4096):
        bits = np.unpackbits(every[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(every), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long."""

    def make():
        def f(x: str) -> int:
            n = fingerprint(x)
            return n - (1 << 64) if n >> 63 else n

        return f

    return df.withColumn(name, common.text_udf(make, "bigint", pa.int64())(F.col(text)))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the one-wildcard variants of its segments."""
    masks, tags, shift = [], [], 0
    for s, width in enumerate(SEGMENTS):
        for bit in range(width):
            masks.append((((1 << width) - 1) ^ (1 << bit)) << shift)
            tags.append((s, bit))
        shift += width
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(fp), 8192):
            part = fp[k : k + 8192]
            out, low = [], 0
            for (s, bit), mask in zip(tags, masks, strict=True):
                low = sum(SEGMENTS[:s])
                value = (part & np.uint64(mask)) >> np.uint64(low)
                out.append((value << np.uint64(8)) | np.uint64(s * 32 + bit))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(part, len(out)).view(np.int64))], names=["variant", "fp"]
            )


class _Forest:
    """Union-find over fingerprints."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self) -> pa.RecordBatch:
        """Every fingerprint that has links, linked to the root of its tree."""
        nodes = list(self.up)
        roots = [self.root(x) for x in nodes]
        self.up.clear()
        ab = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, roots)]
        return pa.RecordBatch.from_arrays(ab, names=["a", "b"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def _bucket(found: _Forest, fp: np.ndarray) -> None:
    """The links within one large bucket: from every member to those not reached
    before, so that a bucket of n makes n links at most and holds n numbers."""
    left = fp
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _near(left, x)
            if near.any():
                reached, left = left[near], left[~near]
                for y in reached.tolist():
                    found.link(int(x), y)
                todo.extend(reached)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints of one bucket, from rows sorted by bucket."""
    found, held = _Forest(), None

    def work(variant: np.ndarray, fp: np.ndarray) -> None:
        n = len(fp)
        if n < 2:
            return
        # small buckets: all at once, by their distance in the order
        cut = np.flatnonzero(np.diff(variant)) + 1
        size = np.diff([0, *cut.tolist(), n])
        start = np.repeat(np.array([0, *cut.tolist()]), size)
        small = size <= SMALL
        of = np.repeat(small, size)
        k = 1
        while k < n and k < SMALL:
            i = np.flatnonzero((start[:-k] == start[k:]) & of[:-k])
            if not len(i):
                break
            i = i[_near(fp[i], fp[i + k])]
            for x, y in zip(fp[i].tolist(), fp[i + k].tolist(), strict=True):
                found.link(x, y)
            k += 1
        for b in np.flatnonzero(~small).tolist():
            a = cut[b - 1] if b else 0
            _bucket(found, fp[a : a + size[b]])

    for batch in batches:
        v, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if held is not None:
            v, f = np.concatenate([held[0], v]), np.concatenate([held[1], f])
        last = int(np.searchsorted(v, v[-1])) if len(v) else 0
        work(v[:last], f[:last])
        held = v[last:].copy(), f[last:].copy()
        if len(found.up) > 500_000:
            yield found.stars()
    if held is not None:
        work(*held)
    yield found.stars()


def link(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints ``fp`` which are near one
    another, directly or through others; ``fps`` holds distinct ones."""
    variants = fps.select("fp").mapInArrow(_variants, "variant bigint, fp bigint")
    return variants.repartition("variant").sortWithinPartitions("variant", "fp").mapInArrow(_links, "a bigint, b bigint")


def cluster(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id, component_fp)`` of every row; the last names
    the component where none of its rows has an id."""
    prints = common.materialize(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "fp"), "prints")
    by = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "by-print")
    groups = components.components(link(by))
    firsts = by.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component_fp"))
    least = firsts.groupBy("component_fp").agg(F.min("first").alias("component_id"))
    named = common.materialize(firsts.join(least, "component_fp").select("fp", "component_id", "component_fp"), "named-print")
    common.discard(by, groups)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "component_fp")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each component the one with its smallest
    id, with all their columns."""
    found = common.materialize(cluster(df, doc_id, text), "clustered")
    own, times, fp, component = common.fresh(df.columns, "own", "times", "fp", "component")
    first = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    first = common.materialize(first, "kept-ids").select(F.col("doc_id").alias(own), F.col("n").alias(times))
    once, again = first.filter(F.col(times) == 1), first.filter(F.col(times) > 1)
    # ids grow with the rows, so they are never sent to every task, however few
    kept = df.join(once.hint("shuffle_hash"), df[doc_id] == F.col(own), "left_semi")
    # rows that share an id, and those without one, are few: they alone are grouped
    if not again.isEmpty():
        many = df.join(again, df[doc_id] == F.col(own), "left_semi").dropDuplicates([doc_id])
        kept = kept.unionAll(many)
    nameless = found.filter("component_id is null").select(F.col("fp").alias(own), F.col("component_fp").alias(component)).distinct()
    if not nameless.isEmpty():
        rows = fingerprints(df.filter(F.col(doc_id).isNull()), text, fp).join(nameless, F.col(fp) == F.col(own))
        kept = kept.unionAll(rows.dropDuplicates([component]).select(*df.columns))
    return kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op3``: the component of every document."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return cluster(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
