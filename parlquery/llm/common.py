"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word memo may hold before it is emptied.
MEMO_ENTRIES = 400_000

#: The white space between words: 0x20 and 0x09 to 0x0D, as bytes.split() has it.
WHITE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table below ``sf_dir``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="parlquery-")  # one machine alone
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a job's exchanges are removed from disk when the job has ended,
    since what it wrote is what is read from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: What is written within the open scopes of ``scratch``.
_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Within, what is materialised is listed, and what the list still holds at
    the end is deleted."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()
        discard(*made)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    with tidy_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def at(spark: SparkSession, path: str):
    """A path of whatever store, and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = at(spark, path)
    return fs.exists(where)


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these."""
    for df in written:
        if path := getattr(df, "_written_at", None):
            where, fs = at(df.sparkSession, path)
            fs.delete(where, True)


def fresh(taken: list[str], *stems: str) -> list[str]:
    """Column names like the stems that are not taken, in any case of letters."""
    used, out = {c.lower() for c in taken}, []
    for stem in stems:
        while stem.lower() in used:
            stem += "_"
        used.add(stem.lower())
        out.append(stem)
    return out


def with_fields(df: DataFrame, found: Column, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with the fields of a struct as columns; columns so named go."""
    (name,) = fresh([*df.columns, *fields], "found")
    done = df.withColumn(name, found)
    return done.withColumns({c: F.col(name)[c] for c in fields}).drop(name)


def text_udf(make: Callable[[], Callable], schema: str, kind: pa.DataType) -> Callable[..., Column]:
    """An Arrow function of whole texts. ``make()`` runs once a task and returns
    ``f(text) -> dict or scalar``; a null text reaches it as an empty one."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for batch in batches:
            yield pa.array([f(x.as_py() or "") for x in batch], type=kind)

    return F.arrow_udf(run, schema, F.ArrowUDFType.SCALAR_ITER)


def sha256(text: str) -> str:
    """Lowercase hexadecimal SHA-256 of the UTF-8 text."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def key_of(*parts) -> Column:
    """A 64-bit hash of columns, alike on every run."""
    return F.xxhash64(*parts)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches of whole groups, with each group's range, from rows sorted by
    their first ``keys`` columns (numbers). Only the last group waits for more."""
    held: list[pa.RecordBatch] = []

    def ranges(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, dtype=bool)
        new[:1] = True
        for k in range(keys):
            c = batch.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), batch.num_rows)

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(k)[-1] == b.column(k)[-1] for k in range(keys))

    def spans(at: np.ndarray) -> list[tuple[int, int]]:
        return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and same(held[-1], batch) and len(ranges(batch)) == 2:
            held.append(batch)
            continue
        whole = pa.concat_batches([*held, batch]) if held else batch
        at = ranges(whole)
        held = [whole.slice(int(at[-2]))]
        if len(at) > 2:
            yield whole.slice(0, int(at[-2])), spans(at[:-1])
    if held:
        whole = pa.concat_batches(held)
        yield whole, spans(ranges(whole))
