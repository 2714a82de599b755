"""Further operators on the same tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure_jobs.functions.timing import HOUR_US, ceil_hours, floor_hours, hour_to_ts, micros
from exposure_jobs.operators.panel import label_columns


def dedupe_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["alert_id"])


def minutes_under_alert(merged: DataFrame) -> DataFrame:
    """Minutes under alert in each hour that has any, to the microsecond."""
    s, e = micros("started_at"), micros("finished_at")
    spans = merged.select("region_id", s.alias("s"), e.alias("e"), floor_hours(s).alias("a"), (ceil_hours(e) - 1).alias("b")).filter("a <= b")
    each = spans.select("region_id", "s", "e", F.explode(F.sequence("a", "b")).alias("h"))
    part = F.least(F.col("e"), (F.col("h") + 1) * HOUR_US) - F.greatest(F.col("s"), F.col("h") * HOUR_US)
    return each.groupBy("region_id", "h").agg((F.sum(part) / 60_000_000).alias("minutes")).filter("minutes > 0").select("region_id", hour_to_ts("h").alias("origin_hour"), "minutes")


def type_union(by_type: DataFrame, keys: list[str]) -> DataFrame:
    """The probability of any type, 1 - product(1 - p), were types independent."""
    return by_type.groupBy(*keys).agg((1 - F.product(1 - F.col("p"))).alias("p"))


def type_union_of(probabilities: list[Column]) -> Column:
    """:func:`type_union` for a row that has the probability of each type."""
    return 1 - reduce(lambda product, p: product * (1 - p), probabilities, F.lit(1.0))


def activity_by_type(typed: DataFrame) -> DataFrame:
    """``typed(region_id, kind, started_at, finished_at)`` → hours in which each kind was active."""
    s, e = micros("started_at"), micros("finished_at")
    spans = typed.select("region_id", "kind", s.alias("s"), floor_hours(s).alias("a"), (ceil_hours(e) - 1).alias("b")).filter("a <= b")
    each = spans.select("region_id", "kind", "s", F.explode(F.sequence("a", "b")).alias("h")).filter(F.col("s") < (F.col("h") + 1) * HOUR_US)
    return each.select("region_id", "kind", hour_to_ts("h").alias("origin_hour")).distinct()


def overlapping_types(merged: DataFrame, typed: DataFrame) -> DataFrame:
    """The kinds of typed alerts that overlap each merged interval; both sides meet in the hours they touch."""
    hours = lambda: F.explode(F.sequence(floor_hours(micros("started_at")), floor_hours(micros("finished_at")))).alias("h")
    a = merged.select("region_id", "started_at", "finished_at", hours()).alias("a")
    b = typed.select("region_id", "kind", F.col("started_at").alias("ts"), F.col("finished_at").alias("te"), hours()).alias("b")
    meet = (F.col("a.region_id") == F.col("b.region_id")) & (F.col("a.h") == F.col("b.h")) & (F.col("b.ts") < F.col("a.finished_at")) & (F.col("b.te") > F.col("a.started_at"))
    return a.join(b, meet).select("a.region_id", "a.started_at", "b.kind").distinct()


def sufficiency(merged: DataFrame, panel: DataFrame) -> DataFrame:
    """History, interval count and positive rate of each label, by region."""
    rates = [F.avg(y).alias(f"rate_{y}") for y in label_columns(panel.columns)]
    hours = panel.groupBy("region_id").agg(F.count("*").alias("hours"), F.avg("active").alias("active_rate"), *rates)
    return hours.join(merged.groupBy("region_id").agg(F.count("*").alias("intervals")), "region_id", "left")


def duration_statistics(events: DataFrame) -> DataFrame:
    length = micros("finished_at") - micros("started_at")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return events.groupBy("region_id").agg(
        F.count("*").alias("n"), count(length == 0).alias("zero"), count((length > 0) & (length < 60_000_000)).alias("sub_minute"), count(F.col("is_outlier_duration")).alias("outlier"), count(F.col("finished_at").isNull()).alias("censored")
    )
