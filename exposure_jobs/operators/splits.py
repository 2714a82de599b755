"""Time-based splits, counted back from each region's own cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def split_boundaries(cutoffs: DataFrame, validation_weeks: int, test_weeks: int) -> DataFrame:
    """``(region_id, data_cutoff)`` → the edges of each region's windows; training ends where validation starts."""
    end = F.unix_micros("data_cutoff")
    test, validation = end - test_weeks * 7 * DAY_US, end - (test_weeks + validation_weeks) * 7 * DAY_US
    at = F.timestamp_micros
    return cutoffs.select("region_id", at(validation).alias("train_end"), at(validation).alias("val_start"), at(test).alias("val_end"), at(test).alias("test_start"), F.col("data_cutoff").alias("test_end"))


def split_columns(t: Column) -> dict[str, Column]:
    """``split`` and ``in_primary_train`` of an origin whose row has its region's edges and days. Edges are closed on the right; what lies
    after the cutoff is holdout. A region without days fails."""
    days = F.when(F.col("primary_train_days").isNull(), F.raise_error("a region needs its primary training days").cast("int")).otherwise(F.col("primary_train_days"))
    start = F.timestamp_micros(F.unix_micros("val_start") - days.cast("bigint") * DAY_US)
    split = F.when((t > F.col("test_start")) & (t <= F.col("test_end")), "test").when((t > F.col("val_start")) & (t <= F.col("val_end")), "validation").when(t <= F.col("train_end"), "train").otherwise("holdout")
    return {"split": split, "in_primary_train": (t >= start) & (t <= F.col("train_end"))}


def annotate_splits(origins: DataFrame, boundaries: DataFrame, train_days: DataFrame) -> DataFrame:
    """``origins`` with the columns of :func:`split_columns`; ``train_days(region_id, primary_train_days)`` is the registry's."""
    joined = origins.join(boundaries, "region_id").join(train_days.select("region_id", "primary_train_days"), "region_id", "left")
    return joined.withColumns(split_columns(F.col("origin_hour"))).select(*origins.columns, "split", "in_primary_train")
