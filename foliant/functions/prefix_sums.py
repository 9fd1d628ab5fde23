"""Running totals over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.storage import cut


def running_total(df: DataFrame, value: str, order: list[str], total: str, ranges: int | None = None) -> DataFrame:
    """Adds ``total``, the sum of ``value`` (nulls count 0) over all rows before, in the given total order.

    Rows are split into ranges of the order; sums of the ranges, of which there are a fixed number, are added up first, and
    each range is then summed by itself. ``order`` must be unique, or ties are ordered at will.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = cut(df.repartitionByRange(ranges, *order).withColumn("_prefix_range", F.spark_partition_id()))
    sums = split.groupBy("_prefix_range").agg(F.sum(F.coalesce(value, F.lit(0))).alias("_prefix_sum"))
    # one row a range: small whatever the table
    earlier = sums.select("_prefix_range", F.coalesce(F.sum("_prefix_sum").over(Window.orderBy("_prefix_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_prefix_earlier"))
    inside = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("_prefix_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return split.join(F.broadcast(earlier), "_prefix_range").withColumn(total, F.col("_prefix_earlier") + F.coalesce(inside, F.lit(0))).drop("_prefix_range", "_prefix_earlier")


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the place of each row from 0 in the given total order."""
    return running_total(df.withColumn("_prefix_one", F.lit(1).cast("bigint")), "_prefix_one", order, name).drop("_prefix_one")


def running_total_within(df: DataFrame, group: str, value: str, order: list[str], total: str) -> DataFrame:
    """``running_total`` for each group by itself. A group of any size is spread over the ranges; a null group is a group."""
    rows = cut(running_total(df, value, [group, *order], "_prefix_total"))
    starts = rows.groupBy(F.col(group).alias("_prefix_group")).agg(F.min("_prefix_total").alias("_prefix_start"))
    return rows.join(starts, F.col(group).eqNullSafe(F.col("_prefix_group"))).withColumn(total, F.col("_prefix_total") - F.col("_prefix_start")).drop("_prefix_total", "_prefix_start", "_prefix_group")


def row_numbers_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``row_numbers`` for each group by itself."""
    return running_total_within(df.withColumn("_prefix_one", F.lit(1).cast("bigint")), group, "_prefix_one", order, name).drop("_prefix_one")
