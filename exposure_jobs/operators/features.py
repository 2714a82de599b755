"""Past-only features of each origin hour: one window pass for each block of a region's hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposure_jobs.functions.timing import ceil_hours, floor_hours, local_calendar, micros
from exposure_jobs.operators.panel import label_columns

KEYS = ["region_id", "origin_hour"]
METADATA = [*KEYS, "split", "in_primary_train"]
#: Hours of a block: a region's calendar is cut every three months or so.
BLOCK_HOURS = 2160


def feature_columns(lag_hours: tuple[int, ...]) -> list[str]:
    return ["active_at_origin", *(f"active_sum_{k}h" for k in lag_hours), "time_since_last_start_h", "time_since_last_end_h", "hour_kyiv", "dow_kyiv", "hour_of_week_kyiv"]


def matrix_features(columns: list[str]) -> list[str]:
    """The feature columns of a training matrix: what is neither metadata nor a label."""
    labels = set(label_columns(columns))
    return [c for c in columns if c not in METADATA and c not in labels]


def last_events(merged: DataFrame) -> DataFrame:
    """By the first hour at or after them, the latest start and the latest end, in microseconds."""
    both = F.array(*(F.struct(micros(c).alias("us"), F.lit(k).alias("kind")) for k, c in enumerate(("started_at", "finished_at"))))
    each = merged.select("region_id", F.explode(both).alias("e")).select("region_id", ceil_hours("e.us").alias("h"), "e.us", "e.kind")
    return each.groupBy("region_id", "h").agg(F.max(F.when(F.col("kind") == 0, F.col("us"))).alias("start_us"), F.max(F.when(F.col("kind") == 1, F.col("us"))).alias("end_us"))


def feature_matrix(panel: DataFrame, merged: DataFrame, lag_hours: tuple[int, ...], timezone: str, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """``panel(region_id, origin_hour, active, active_at_origin, ...)`` and its intervals → one row of features for each origin.

    Lag sums take earlier hours only (the panel is dense, so rows are hours). Hours since the last start or end count whole seconds
    of the latest one at or before the origin, and are null before the first.

    A region's hours are cut into blocks, so that a long calendar is many tasks. The last hours of a block, as many as the longest lag,
    are copied into the blocks that look back on them; the last start and end before a block are the running maximum over the region's
    blocks, one row each.
    """
    h, longest = floor_hours(micros("origin_hour")), max(lag_hours, default=0)
    block = lambda hour: F.floor(hour / block_hours)
    last = last_events(merged).withColumn("block", block(F.col("h")))
    carried = Window.partitionBy("region_id").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    known = last.groupBy("region_id", "block").agg(F.max("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    # a block without events needs what earlier ones had, so the blocks are those of the panel
    blocks = panel.select("region_id", block(h).alias("block")).distinct().join(known, ["region_id", "block"], "full")
    before = blocks.select("region_id", "block", F.max("start_us").over(carried).alias("start_before"), F.max("end_us").over(carried).alias("end_before"))
    own = panel.select(*KEYS, "active", "active_at_origin", h.alias("h")).withColumn("own", block(F.col("h")))
    copied = own.withColumn("block", F.explode(F.sequence("own", block(F.col("h") + longest))))
    rows = copied.join(last.drop("block"), ["region_id", "h"], "left").join(before, ["region_id", "block"], "left")
    order = Window.partitionBy("region_id", "block").orderBy("h")
    sums = [F.coalesce(F.sum("active").over(order.rowsBetween(-k, -1)), F.lit(0)).cast("int").alias(f"active_sum_{k}h") for k in lag_hours]
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.greatest(F.col(f"{c}_before"), F.max(f"{c}_us").over(upto)) for c in ("start", "end")]
    since = [(F.floor((micros("origin_hour") - c) / 1_000_000) / 3600).alias(n) for c, n in zip(latest, ("time_since_last_start_h", "time_since_last_end_h"), strict=True)]
    calendar = [c.alias(n) for n, c in local_calendar("origin_hour", timezone).items()]
    made = rows.select(*KEYS, "active_at_origin", *sums, *since, *calendar, (F.col("own") == F.col("block")).alias("own"))
    return made.filter("own").drop("own")


def hour_features(hours: DataFrame, lag_hours: tuple[int, ...], timezone: str) -> DataFrame:
    """The hours of ``panel.region_hours``, with ``origin_hour`` and the flags, and the features of :func:`feature_matrix` beside their columns.

    Hours are dense, so a lag sum is the difference of two running sums. Windows go over a region's calendar, as its hours were dealt.
    """
    order = Window.partitionBy("region_id").orderBy("h")
    upto = hours.withColumn("__upto", F.sum("active").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = {f"active_sum_{k}h": (F.lag("__upto", 1, 0).over(order) - F.lag("__upto", k + 1, 0).over(order)).cast("int") for k in lag_hours}
    since = {f"time_since_last_{c}_h": F.floor((micros("origin_hour") - F.col(f"{c}_us")) / 1_000_000) / 3600 for c in ("start", "end")}
    return upto.withColumns(sums).withColumns(since | local_calendar("origin_hour", timezone)).drop("__upto")


def training_matrix(features: DataFrame, origins: DataFrame) -> DataFrame:
    """Features beside labels and split columns, one to one; ``active`` looks past the origin and stays out."""
    rest = [c for c in origins.columns if c not in (*KEYS, "active", "active_at_origin")]
    return features.join(origins.select(*KEYS, *rest), KEYS)


def repeated_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n")).filter("n > 1")
