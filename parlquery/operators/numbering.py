"""Running values over whole tables without one task that holds a whole group.

Rows are cut into blocks along their order; a window over blocks carries what
comes before each block, and a window within each block does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(df: DataFrame, value: Column, name: str, group: str, order: str, block: Column) -> DataFrame:
    """Add the greatest ``value`` of the group up to and with each row. ``block``
    must not fall along ``order``."""
    df = df.withColumns({"__v": value, "__b": block})
    upto = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(group, "__b").agg(F.max("__v").alias("__m")).withColumn("__c", F.max("__m").over(upto)).drop("__m")
    inside = Window.partitionBy(group, "__b").orderBy(order)
    out = df.withColumn("__in", F.max("__v").over(inside)).join(carried, [group, "__b"])
    return out.withColumn(name, F.greatest("__in", "__c")).drop("__v", "__b", "__in", "__c")


def dense_ids(df: DataFrame, name: str, order: list[str], block: Column) -> DataFrame:
    """Number all rows from 1 in an order, of which ``block`` is a coarse view."""
    df = df.withColumn("__b", block)
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__b").orderBy(*order)
    out = df.withColumn("__i", F.row_number().over(inside)).join(first, "__b")
    return out.withColumn(name, (F.col("__first") + F.col("__i")).cast("bigint")).drop("__b", "__i", "__first")
