"""Operator 10: token ids in training order, as fixed-stride shards.

Texts become sequences of ``SEQ_LEN`` token ids (two bytes each, little-endian,
the last one filled up with the end token). The sequences are written once and
numbered: each input partition counts its own, and a prefix sum over partitions
gives every sequence an index from 0. A keyed Feistel permutation with
cycle-walking sends the index to a global slot, which needs no shuffled list of
all sequences. Ranges of slots are the partitions of one exchange; in each, rows
sorted by slot are the records of shards.

A shard is one binary file of ``SHARD_SEQ`` records of ``stride`` bytes: slot,
document, place in the document (eight bytes each, big-endian), number of tokens
(two), whether there is a document's id (one), the token ids, and a line end. So
slot s is at byte ``s % SHARD_SEQ * stride`` of the file in folder
``shard=<s // SHARD_SEQ>``; a reader seeks there and reads on, file after file.
Shards are written in ``WAVES`` waves, each a job whose exchange is removed when
it ends. A writer that was killed goes on with the waves that are not whole.

Defined cases: a null or empty text has no token and no sequence; very long texts
become as many sequences as they need; an empty table gives no rows and no shard;
repeated rows have sequences of their own; there are no ties, since slots differ;
an id that is no whole number counts as null; extra columns do not matter,
whatever their names, since only the id and the text are read.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .feistel import permute

SEQ_LEN = 512
SHARD_SEQ = 4096
KEY = 20_240

#: Bytes of records that one partition writes, about.
PARTITION_BYTES = 64 << 20

#: Waves in which shards are written.
WAVES = 4

#: Sequences that a task hands on at a time.
BATCH_SEQ = 1024

#: What stands before the token ids of a record, and after them.
HEAD, TAIL = ">qqqHb", b"\n"
HEAD_BYTES = struct.calcsize(HEAD)

#: The end token, which the vocabulary leaves free.
END = 50_256


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteBpe:
    """Byte-level BPE; ids as two bytes each."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), dtype="<u2").tobytes()

    def decode(self, ids: bytes) -> str:
        return self.coder.decode([i for i in np.frombuffer(ids, dtype="<u2").tolist() if i != END])


def cut(batches: Iterator[pa.RecordBatch], coder: ByteBpe, part: int, seq_len: int = SEQ_LEN) -> Iterator[pa.RecordBatch]:
    """The sequences of the texts in batches, ``BATCH_SEQ`` at a time, however many
    texts come at once and however long they are."""
    at, stride = 0, 2 * seq_len
    doc, no, n, ids = held = [], [], [], []

    def batch() -> pa.RecordBatch:
        rows = len(doc)
        columns = [pa.array([part] * rows, pa.int64()), pa.array(np.arange(at, at + rows)), *(pa.array(x, pa.int64()) for x in (doc, no, n)), pa.array(ids, pa.binary())]
        for x in held:
            x.clear()
        return pa.RecordBatch.from_arrays(columns, names=["part", "at", "doc_id", "seq_no", "n_tokens", "ids"])

    for rows in batches:
        for d, x in zip(rows.column(0), rows.column(1), strict=True):
            raw, own = coder.encode(x.as_py() or ""), d.as_py()
            for k in range(0, len(raw), stride):
                doc.append(own)
                no.append(k // stride)
                ids.append(raw[k : k + stride])
                n.append(len(ids[-1]) // 2)
                if len(doc) == BATCH_SEQ:
                    yield batch()
                    at += BATCH_SEQ
    if doc:
        yield batch()


def sequences(df: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN) -> DataFrame:
    """``(part, at, doc_id, seq_no, n_tokens, ids)``: the sequences of every
    text, counted within the partition that makes them; written once, so that
    the numbering holds from then on."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return cut(batches, ByteBpe(path), TaskContext.get().partitionId(), seq_len)

    rows = df.select(F.col(doc_id).try_cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return common.materialize(rows.mapInArrow(run, "part bigint, at bigint, doc_id bigint, seq_no bigint, n_tokens bigint, ids binary"), "sequences")


def stride_of(seq_len: int = SEQ_LEN) -> int:
    return HEAD_BYTES + 2 * seq_len + len(TAIL)


def slots(seqs: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """The sequences with their slots, and how many there are."""
    # a row for each input partition
    counts = seqs.groupBy("part").agg((F.max("at") + 1).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = common.materialize(counts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"), "n"), "sequence-parts")
    total = first.agg(F.sum("n")).first()[0] or 0

    def to_slot(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(permute(batch.to_numpy(), total, key))

    # said to be nondeterministic, lest a filter on the slot is pushed below it: the
    # plan would hold it twice, with two Python workers to a task
    slot = F.arrow_udf(to_slot, "bigint", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    rows = seqs.join(first.select("part", "first"), "part").withColumn("slot", slot(F.col("first") + F.col("at")))
    return rows.drop("part", "at", "first"), total


def in_order(rows: DataFrame, low: int, high: int, seq_len: int = SEQ_LEN, shard_seq: int = SHARD_SEQ) -> DataFrame:
    """``(shard, slot, record)`` of the shards from ``low`` to before ``high``, the
    rows of a partition being whole shards with their slots in order."""
    rows = rows.withColumn("shard", F.floor(F.col("slot") / shard_seq).cast("bigint")).filter((F.col("shard") >= low) & (F.col("shard") < high))
    stride, shards = stride_of(seq_len), max(1, high - low)
    session_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = int(max(1, min(shards, max(session_parts, -(-shards * shard_seq * stride // PARTITION_BYTES)))))
    # whole shards to a partition, neighbours together: an exact range without sampling
    rows = rows.repartitionById(parts, ((F.col("shard") - low) * parts / F.lit(shards)).cast("int")).sortWithinPartitions("shard", "slot")
    number = lambda c, digits: F.lpad(F.hex(F.col(c)), digits, "0")
    head = F.unhex(F.concat(number("slot", 16), F.coalesce(number("doc_id", 16), F.lit("0" * 16)), number("seq_no", 16), number("n_tokens", 4), F.when(F.col("doc_id").isNull(), "00").otherwise("01")))
    fill = F.unhex(F.repeat(F.lit(END.to_bytes(2, "little").hex()), (F.lit(seq_len) - F.col("n_tokens")).cast("int")))
    return rows.select("shard", "slot", F.concat(head, "ids", fill).alias("record"))


def write(rows: DataFrame, total: int, path: str, seq_len: int = SEQ_LEN, shard_seq: int = SHARD_SEQ, waves: int = WAVES) -> None:
    """Write all shards below ``path``. Waves that are there as a whole stay, as
    a writer left them that was killed; an unfinished one is written anew."""
    spark, shards = rows.sparkSession, -(-total // shard_seq)
    cuts = [shards * w // waves for w in range(waves + 1)]
    for w, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        at = f"{path}/wave={w}"
        if low == high or common.exists(spark, f"{at}/_SUCCESS"):
            continue
        # the text sink writes a record's bytes as they are, and TAIL
        found = in_order(rows, low, high, seq_len, shard_seq).select("shard", F.col("record").cast("string").alias("value"))
        with common.tidy_shuffles(spark):
            found.write.mode("overwrite").option("compression", "none").option("lineSep", TAIL.decode()).partitionBy("shard").text(at)


def read(spark: SparkSession, path: str, seq_len: int = SEQ_LEN, shard_seq: int = SHARD_SEQ) -> DataFrame:
    """``(slot, shard, byte_offset, doc_id, seq_no, n_tokens, record)`` of all
    shards, a record being the token ids. A record out of its place raises."""
    stride = stride_of(seq_len)
    kind = np.dtype([("slot", ">i8"), ("doc_id", ">i8"), ("seq_no", ">i8"), ("n_tokens", ">u2"), ("named", "i1"), ("ids", f"S{2 * seq_len}"), ("tail", "S1")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                found = np.frombuffer(raw, dtype=kind)
                slot, at = found["slot"].astype(np.int64), np.arange(len(found), dtype=np.int64)
                if (slot != shard * shard_seq + at).any():
                    raise ValueError(f"shard {shard} holds a record out of its place")
                ids = [raw[k + HEAD_BYTES : k + HEAD_BYTES + 2 * seq_len].to_pybytes() for k in range(0, len(found) * stride, stride)]
                doc = pa.array(found["doc_id"].astype(np.int64), mask=found["named"] == 0)
                columns = [pa.array(slot), pa.array(np.full(len(slot), shard, dtype=np.int64)), pa.array(at * stride), doc]
                columns += [pa.array(found["seq_no"].astype(np.int64)), pa.array(found["n_tokens"].astype(np.int64)), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "record"])

    schema = "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, seq_no bigint, n_tokens bigint, record binary"
    if not common.exists(spark, path):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("shard").cast("bigint"), "content").mapInArrow(cut, schema)


def resume(spark: SparkSession, path: str, slot: int = 0, seq_len: int = SEQ_LEN, shard_seq: int = SHARD_SEQ, ahead: int = 1024) -> Iterator[tuple[int, bytes]]:
    """``(slot, token ids)`` from a slot on, in order: the reader seeks to the
    record in its shard and goes on from there, file after file. ``ahead``
    records at a time are held."""
    jvm, stride = spark._jvm, stride_of(seq_len)
    while True:
        pattern, fs = common.at(spark, f"{path}/wave=*/shard={slot // shard_seq}/part-*")
        files = fs.globStatus(pattern)
        if not files:
            return
        left = files[0].getLen() // stride - slot % shard_seq
        stream = fs.open(files[0].getPath())
        try:
            stream.seek(slot % shard_seq * stride)
            while left > 0:
                raw = bytes(jvm.org.apache.commons.io.IOUtils.readFully(stream, min(left, ahead) * stride))
                for k in range(0, len(raw), stride):
                    if struct.unpack_from(HEAD, raw, k)[0] != slot:
                        raise ValueError(f"slot {slot} is not in its place")
                    yield slot, raw[k + HEAD_BYTES : k + stride - len(TAIL)]
                    slot += 1
                left -= ahead
        finally:
            stream.close()
        if slot % shard_seq:
            return


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10``: all documents' sequences, as the written shards hold them."""
    seqs = sequences(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    rows, total = slots(seqs)
    path = common.new_path(spark, "training-shards")
    write(rows, total, path)
    common.discard(seqs)
    return read(spark, path)
