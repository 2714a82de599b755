"""Data-quality jobs: each gives a table of errors, empty when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposure_jobs.functions.timing import HOUR_US, ceil_hours, floor_hours, invalid, micros
from exposure_jobs.operators.panel import label_columns


def validate_raw(raw: DataFrame, columns: list[str], row_count: int, tolerance: float = 0.01) -> DataFrame:
    """Header and row count against a manifest."""
    header = raw.columns
    n = F.count("*")
    drift = raw.agg(n.alias("n")).filter(F.abs(F.col("n") - row_count) > tolerance * max(row_count, 1))
    errors = drift.select(F.lit("row_count").alias("check"), F.concat(F.lit(f"expected {row_count}, found "), F.col("n")).alias("detail"))
    if header != columns:
        errors = errors.union(raw.sparkSession.createDataFrame([("header", f"expected {columns}, found {header}")], "check string, detail string"))
    return errors


def negative_durations(events: DataFrame) -> DataFrame:
    return events.filter(invalid("started_at", "finished_at"))


def overlapping_intervals(merged: DataFrame) -> DataFrame:
    """Merged rows that end before they start, or start at or before the end of the one before."""
    before = F.lag("finished_at").over(Window.partitionBy("region_id").orderBy("started_at", "finished_at"))
    return merged.withColumn("previous_end", before).filter(invalid("started_at", "finished_at") | (F.col("started_at") <= F.col("previous_end")))


def label_mismatches(panel: DataFrame, merged: DataFrame, horizons: list[int] | None = None) -> DataFrame:
    """Labels recomputed from the intervals by their written definition, where they differ from the stored ones.

    A different route from the panel's: intervals and origins meet in day buckets, each pair is tested, and any hit makes the label. A
    pair that is not over at the origin says from which horizon on it is seen; the least of a bucket's pairs answers for all horizons at
    once, the stored labels ride along, and only what differs becomes a row for a horizon.
    """
    horizons = [int(c[2:]) for c in label_columns(panel.columns)] if horizons is None else horizons
    day = lambda us: F.floor(floor_hours(us) / 24)
    asked = panel.select("region_id", "origin_hour", day(micros("origin_hour")).alias("day"), F.array(*(F.col(f"y_{k}").cast("tinyint") for k in horizons)).alias("labels"))
    days = F.sequence(day(micros("started_at") - F.lit(max(horizons) * HOUR_US)), day(micros("finished_at")))
    spans = merged.select("region_id", "started_at", "finished_at", F.explode(days).alias("day"))
    seen_from = F.when(F.col("finished_at") > F.col("origin_hour"), ceil_hours(micros("started_at") - micros("origin_hour")))
    found = asked.join(spans, ["region_id", "day"], "left").groupBy("region_id", "day", "origin_hour", "labels").agg(F.min(seen_from).alias("least"))
    want = lambda k: F.coalesce((F.col("least") <= k).cast("int"), F.lit(0))
    label = lambda i: F.get("labels", F.lit(i)).cast("int")
    wrong = found.filter(reduce(lambda a, b: a | b, (label(i) != want(k) for i, k in enumerate(horizons))))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), label(i).alias("y"), want(k).alias("want")) for i, k in enumerate(horizons))))
    return wrong.select("region_id", "origin_hour", each.alias("e")).select("region_id", "origin_hour", "e.*").filter("y <> want")
