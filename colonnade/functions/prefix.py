"""Row numbers and running sums over the whole table without sending it to one task.

Rows are range-partitioned on the order, each partition works alone, and the partitions' totals
(as many rows as there are partitions) give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions.shared import cut


def _ranged(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from a sample, so the partition number must be fixed before it is used twice.
    return cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def _offsets(totals: DataFrame, *sums: str) -> DataFrame:
    """Totals of all earlier partitions; at most one row for each partition, so one window is enough."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("__part", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums)))


def global_row_number(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order given; ties must be broken by the order itself."""
    ranged = _ranged(df, order, parts)
    offsets = _offsets(ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), "__n")
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(name, local).join(offsets, "__part").withColumn(name, (F.col(name) + F.col("__n_before")).cast("long")).drop("__part", "__n_before")


def global_running_sum(df: DataFrame, order: list[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and including the row, in the order given; nulls are skipped."""
    ranged = _ranged(df, order, parts)
    offsets = _offsets(ranged.groupBy("__part").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__s")), "__s")
    local = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return ranged.withColumn(name, local).join(offsets, "__part").withColumn(name, F.col(name) + F.col("__s_before")).drop("__part", "__s_before")


def global_last_before(df: DataFrame, order: list[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds ``name``: the last value before the row, in the order given, that is not null."""
    ranged = _ranged(df, order, parts)
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = ranged.withColumn("__l", F.last(value, ignorenulls=True).over(ends)).groupBy("__part").agg(F.first("__l").alias("__l"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(lasts.select("__part", F.last("__l", ignorenulls=True).over(earlier).alias("__e")))
    local = F.last(value, ignorenulls=True).over(before)
    return ranged.withColumn(name, local).join(offsets, "__part").withColumn(name, F.coalesce(name, "__e")).drop("__part", "__e")
