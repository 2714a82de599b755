"""Overlapping alerts to disjoint intervals, all regions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposure_jobs.operators.clean import is_outlier


def close_open(events: DataFrame, data_cutoff: str | None) -> DataFrame:
    """Open alerts end at the cutoff; without a cutoff one of them fails the job. An alert that ends before it starts fails it too."""
    end = F.coalesce(F.col("finished_at"), F.lit(data_cutoff).cast("timestamp"))
    no_end = F.raise_error("an open alert needs a data cutoff").cast("timestamp")
    negative = F.raise_error("an alert ends before it starts").cast("timestamp")
    checked = F.when(end.isNull(), no_end).when(end < F.col("started_at"), negative).otherwise(end)
    return events.withColumn("censored", F.col("finished_at").isNull()).withColumn("finished_at", checked)


def _islands(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("started_at", "finished_at")
    reach = F.max("finished_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("started_at") > reach), 1).otherwise(0)
    numbered = rows.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at")).drop("__island")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """``(region_id, started_at, finished_at)`` → disjoint intervals; those that only touch merge, those of no length stay.

    Merging is associative, so a region's months merge on their own first. Then only an earlier month's reach can join the islands of a
    month: the running maximum over the region's months, a small table, is carried into each. An island that it covers belongs to the
    last one that begins anew before the month. So no task gets more than a region's month, and equal starts collapse before the first shuffle.
    """
    first = intervals.groupBy("region_id", "started_at").agg(F.max("finished_at").alias("finished_at"))
    month = ["region_id", "__month"]
    monthly = _islands(first.withColumn("__month", F.date_trunc("month", "started_at")), month)
    carried = monthly.join(_before_each_month(monthly, "finished_at", "__reach"), month, "left")
    begins = F.when(F.col("__reach").isNull() | (F.col("started_at") > F.col("__reach")), F.col("started_at"))
    marked = carried.withColumn("__begin", begins).drop("__reach")
    marked = marked.join(_before_each_month(marked, "__begin", "__open"), month, "left")
    named = marked.withColumn("__island", F.coalesce("__begin", "__open"))
    return named.groupBy("region_id", "__island").agg(F.max("finished_at").alias("finished_at")).select("region_id", F.col("__island").alias("started_at"), "finished_at")


def _before_each_month(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``(region_id, __month, name)``: the greatest ``column`` in the earlier months of a region, from one row for each month."""
    months = rows.groupBy("region_id", "__month").agg(F.max(column).alias(name))
    earlier = Window.partitionBy("region_id").orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    return months.withColumn(name, F.max(name).over(earlier))


def merged_intervals(events: DataFrame, data_cutoff: str | None = None, outlier_days: int = 7) -> DataFrame:
    """Events with ``region_id`` → the region's merged intervals with their outlier flag: active if any sub-area is."""
    closed = close_open(events, data_cutoff).select("region_id", "started_at", "finished_at")
    return merge_intervals(closed).withColumn("is_outlier_duration", is_outlier("started_at", "finished_at", outlier_days))


def data_cutoffs(merged: DataFrame) -> DataFrame:
    return merged.groupBy("region_id").agg(F.min("started_at").alias("first_start"), F.max("finished_at").alias("data_cutoff"))
