"""Lines of JSON session files and the values in them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm

_TEXT_BLOCKS = ("text", "input_text", "output_text")


def split_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to their lines that are not blank; one that is not UTF-8 is null."""
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            no, raw = [], []
            for k, line in enumerate(data.as_py().split(b"\n")):
                try:
                    line = line.decode("utf-8").strip()
                except UnicodeDecodeError:
                    line = None
                if line != "":
                    no.append(k)
                    raw.append(line)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(no), pa.string()), pa.array(no, pa.int64()), pa.array(raw, pa.string())], names=["path", "line_no", "raw"])


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, line_no, raw)`` of the files' lines, in the executors."""
    if not paths:
        return spark.createDataFrame([], "path string, line_no bigint, raw string")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    lines = files.mapInArrow(split_lines, "path string, line_no bigint, raw string")
    return lines.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def parsed(lines: DataFrame) -> DataFrame:
    """Add ``v``, the line as a variant; null where it is not JSON."""
    return lines.withColumn("v", F.try_parse_json("raw"))


def skipped_lines(lines: DataFrame) -> DataFrame:
    """``(path, skipped)``: lines that are not UTF-8 or not JSON."""
    return parsed(lines).groupBy("path").agg(F.count_if(F.col("v").isNull()).alias("skipped"))


def at(v: Column, path: str) -> Column:
    """What is at a path, a variant; null only where there is nothing."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """``STRING``, ``OBJECT``, ``ARRAY``, ... of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def string_at(v: Column, path: str) -> Column:
    """A string at a path; null if there is none or something else."""
    found = at(v, path)
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def time_at(v: Column, path: str) -> Column:
    """A time at a path: whole milliseconds as a number, or an ISO string."""
    found = at(v, path)
    number = F.when(kind(found) == "BIGINT", F.try_variant_get(found, "$", "bigint"))
    return F.coalesce(number, tm.iso_ms(string_at(v, path)))


def blocks(content: Column) -> Column:
    """The elements of a content that is an array, else null."""
    return F.when(kind(content) == "ARRAY", F.try_variant_get(content, "$", "array<variant>"))


def text_of(content: Column) -> Column:
    """The text of a content: a string as it is, or the text blocks of an array,
    line by line; without noise tags."""
    kept = F.filter(F.transform(blocks(content), lambda b: F.when(string_at(b, "$.type").isin(*_TEXT_BLOCKS), string_at(b, "$.text"))), lambda t: t.isNotNull())
    joined = F.aggregate(kept, F.lit(""), lambda acc, t: F.when(acc == "", t).otherwise(F.concat(acc, F.lit("\n"), t)))
    own = F.when(kind(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return tx.strip_noise_tags(F.coalesce(own, joined, F.lit("")))
