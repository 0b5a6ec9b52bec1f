"""Vectors: distances and the deterministic embedder of tests."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..operators.numbering import dense_ids
from . import text as tx

DIMS = 64


class Embedder(Protocol):
    """What the engine asks of an embedding model. ``count_tokens(text)``, where
    there is one, says how much of a forward pass a text takes; else bytes do."""

    dims: int

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        """A vector for each text, or several in rows; raises if one cannot be
        embedded."""


class ByteEmbedder:
    """Unit vectors of byte sums, alike on every machine; needs no model."""

    def __init__(self, dims: int = DIMS, poison: str | None = None):
        self.dims, self.poison = dims, poison

    def embed(self, texts: list[str]) -> list[np.ndarray]:
        if self.poison is not None and any(self.poison in t for t in texts):
            raise ValueError("a text of the batch cannot be embedded")
        out = []
        for t in texts:
            data = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            v = np.bincount(np.arange(len(data)) % self.dims, weights=data, minlength=self.dims)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32))
        return out


def l2(column: Column, query: list[float]) -> Column:
    """Euclidean distance in double precision."""
    q = F.array(*[F.lit(float(x)) for x in query])
    gap = F.zip_with(column, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def passes(tokens: list[int], budget: int | None) -> Iterator[tuple[int, int]]:
    """Ranges of texts that one forward pass takes: padded to the longest of them,
    no more tokens than the budget, but for a text that has more alone."""
    a = most = 0
    for k, n in enumerate(tokens):
        if budget is not None and k > a and max(most, n) * (k + 1 - a) > budget:
            yield a, k
            a, most = k, 0
        most = max(most, n)
    if a < len(tokens):
        yield a, len(tokens)


def batch_numbers(chunks: DataFrame, batch: int = model.EMBED_BATCH) -> DataFrame:
    """``(chunk_id, batch)``: ascending byte length, so that a batch pads little.
    Rows are numbered in blocks of a length and a range of ids, so no task has all
    chunks of one length."""
    rows = chunks.select("chunk_id", F.octet_length("content").cast("bigint").alias("bytes"))
    block = F.struct("bytes", F.floor(F.col("chunk_id") / (1 << 20)))
    place = dense_ids(rows, "k", ["bytes", "chunk_id"], block)
    return place.select("chunk_id", F.floor((F.col("k") - 1) / batch).cast("bigint").alias("batch"))


def embed_batches(chunks: DataFrame, embedder: Embedder, batch: int = model.EMBED_BATCH, token_budget: int | None = None) -> DataFrame:
    """``(chunk_id, sub_idx, embedding, error)``: batches of like length; a batch
    that fails has an error and no vectors, and the others go on. A text may have
    several vectors."""
    count = getattr(embedder, "count_tokens", lambda t: len(t.encode("utf-8", "surrogatepass")))

    def embed(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        rows: list[tuple] = []
        try:
            for a, b in passes([count(t) for t in texts], token_budget):
                for i, found in zip(ids[a:b], embedder.embed(texts[a:b]), strict=True):
                    rows += [(i, k, v.tolist(), None) for k, v in enumerate(np.atleast_2d(found))]
        except Exception as e:  # the batch stays pending
            rows = [(i, 0, None, tx.cap_note(str(e))) for i in ids]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.float32()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk_id", "sub_idx", "embedding", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, texts = None, [], []
        for rows in batches:
            for number, i, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if number != now and ids:
                    yield embed(ids, texts)
                    ids, texts = [], []
                now = number
                ids.append(i)
                texts.append(text)
        if ids:
            yield embed(ids, texts)

    ordered = chunks.select("chunk_id", "content").join(batch_numbers(chunks, batch), "chunk_id")
    ordered = ordered.select("batch", "chunk_id", "content").repartition("batch").sortWithinPartitions("batch", F.octet_length("content"), "chunk_id")
    return ordered.mapInArrow(run, "chunk_id bigint, sub_idx int, embedding array<float>, error string")
