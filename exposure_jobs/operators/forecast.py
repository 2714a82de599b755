"""The forecast from one origin of each region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure_jobs.operators.model import predict_raw


def pick_origins(matrix: DataFrame, at: str = "latest") -> DataFrame:
    """``(region_id, origin_hour)``: the last origin of each region, or the hour of ``at`` (UTC unless it has an offset)."""
    if at == "latest":
        return matrix.groupBy("region_id").agg(F.max("origin_hour").alias("origin_hour"))
    return matrix.select("region_id").distinct().withColumn("origin_hour", F.date_trunc("hour", F.lit(at).cast("timestamp")))


def forecast_rows(matrix: DataFrame, origins: DataFrame) -> DataFrame:
    """The matrix row of each picked origin; a region with none, or with more than one, fails."""
    met = origins.withColumnRenamed("region_id", "__r").withColumnRenamed("origin_hour", "__o")
    counted = met.join(matrix, (F.col("__r") == F.col("region_id")) & (F.col("__o") == F.col("origin_hour")), "left")
    counts = counted.groupBy("__r").agg(F.count("region_id").alias("__n"))
    one = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("not exactly one row to forecast from for "), F.col("__r"))).cast("boolean"))
    return counted.join(counts, "__r").filter(one).select(*matrix.columns)


def forecast(matrix: DataFrame, parameters: DataFrame, calibrators: DataFrame, regions: DataFrame, features: list[str], timezone: str, at: str = "latest") -> DataFrame:
    """``region_id, display_name, origin_hour, origin_local, horizon, probability`` for all regions at once."""
    rows = forecast_rows(matrix, pick_origins(matrix, at))
    made = predict_raw(rows, parameters, features, calibrators=calibrators)
    named = made.join(regions.select("region_id", "display_name"), "region_id", "left")
    return named.select("region_id", "display_name", "origin_hour", F.from_utc_timestamp("origin_hour", timezone).alias("origin_local"), "horizon", F.col("p").alias("probability"))


def listing(forecasts: DataFrame) -> DataFrame:
    """A line for each region and horizon, probabilities with two decimals."""
    line = F.concat_ws("  ", F.coalesce("display_name", "region_id"), F.date_format("origin_local", "yyyy-MM-dd HH:mm"), F.concat(F.lit("+"), F.col("horizon"), F.lit("h")), F.format_number("probability", 2))
    return forecasts.select("region_id", "horizon", line.alias("line")).orderBy("region_id", "horizon")


def monotone_columns(columns: list[str]) -> dict[str, Column]:
    """:func:`monotone` for a row that has a probability for each horizon, in columns by ascending horizon."""
    return {c: F.greatest(*columns[: i + 1]) if i else F.col(c) for i, c in enumerate(columns)}


def monotone(predictions: DataFrame) -> DataFrame:
    """Probabilities made non-decreasing in the horizon, by a running maximum."""
    upto = Window.partitionBy("region_id", "origin_hour").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    return predictions.withColumn("p", F.max("p").over(upto))
