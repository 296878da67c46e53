"""Ordered operators on timelines too long for one task: each key's line is cut into buckets of its order column.

A bucket is summarised in one row, the summaries of a key are combined in order, and what a bucket needs of the rows before
it is joined back. A key with a third of all rows is then spread over its buckets; only summaries meet in one task.
``bucket`` is the width of a bucket in units of the (numeric) order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cut(df: DataFrame, order: str, bucket: float) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(order) / bucket))


def _before(key: list[str]):
    return Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def _inside(key: list[str], by: list[str]):
    return Window.partitionBy(*key, "__b").orderBy(*by)


def running(df: DataFrame, key: list[str], by: list[str], bucket: float, value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows up to this one; ``by``: the order columns, the first numeric."""
    rows = _cut(df.withColumn("__v", value), by[0], bucket)
    sums = rows.groupBy(*key, "__b").agg(F.sum("__v").alias("__s")).withColumn("__o", F.coalesce(F.sum("__s").over(_before(key)), F.lit(0))).drop("__s")
    here = F.sum("__v").over(_inside(key, by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, [*key, "__b"]).withColumn(out, here + F.col("__o")).drop("__v", "__o", "__b")


def row_index(df: DataFrame, key: list[str], by: list[str], bucket: float, out: str) -> DataFrame:
    """Adds the row's number in its key, from 1."""
    return running(df, key, by, bucket, F.lit(1), out)


def carried(df: DataFrame, key: list[str], by: list[str], bucket: float, value: Column, out: str) -> DataFrame:
    """Adds the last non-null ``value`` of the rows up to this one."""
    rows = _cut(df.withColumn("__v", value), by[0], bucket)
    last = rows.where("__v IS NOT NULL").groupBy(*key, "__b").agg(F.max_by("__v", F.struct(*by)).alias("__l"))
    every = rows.select(*key, "__b").distinct().join(last, [*key, "__b"], "left")
    every = every.withColumn("__o", F.last("__l", ignorenulls=True).over(_before(key))).drop("__l")
    here = F.last("__v", ignorenulls=True).over(_inside(key, by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(every, [*key, "__b"]).withColumn(out, F.coalesce(here, "__o")).drop("__v", "__o", "__b")


def previous(df: DataFrame, key: list[str], by: list[str], bucket: float, value: str, out: str) -> DataFrame:
    """Adds the row before's ``value`` (null for the first row)."""
    rows = _cut(df, by[0], bucket)
    last = rows.groupBy(*key, "__b").agg(F.max_by(value, F.struct(*by)).alias("__l")).withColumn("__o", F.lag("__l").over(Window.partitionBy(*key).orderBy("__b"))).drop("__l")
    here = F.row_number().over(_inside(key, by))
    found = F.when(here == 1, F.col("__o")).otherwise(F.lag(value).over(_inside(key, by)))
    return rows.join(last, [*key, "__b"]).withColumn(out, found).drop("__o", "__b")
