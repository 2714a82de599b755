"""The driver's ``events`` table as a raw alert feed: users are regions, values are minutes under alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure_jobs.config import Settings
from exposure_jobs.jobs.process import RegionTables, build_tables
from exposure_jobs.operators.clean import canonical_events
from exposure_jobs.sources.alerts import RAW_COLUMNS

#: Thirty days of events: short windows, an era edge amid the data, and an end for the alerts that are still open.
SETTINGS = Settings(validation_weeks=1, test_weeks=1, era_cutoff="2024-01-15 00:00:00")
DATA_CUTOFF, PRIMARY_DAYS, OPEN_EVERY = "2024-02-01 00:00:00", 10, 1009


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as text rows of the raw feed; every OPEN_EVERY-th alert has no end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    end = F.timestamp_seconds(F.unix_seconds(start) + F.floor(F.col("value") * 60))
    text = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ssxxx")
    kind = F.col("event_id") % 3
    columns = {
        "oblast": F.concat(F.lit("r"), "user_id"),
        "raion": F.when(kind >= 1, F.col("event_type")),
        "hromada": F.when(kind == 2, F.col("event_type")).otherwise(""),
        "level": F.when(kind == 0, "oblast").when(kind == 1, "raion").otherwise("hromada"),
        "started_at": text(start),
        "finished_at": F.when(F.col("event_id") % OPEN_EVERY == 0, "").otherwise(text(end)),
        "source": F.lit("official"),
    }
    return events.select(*(columns[c].alias(c) for c in RAW_COLUMNS))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = canonical_events(raw_alerts(spark, sf_dir), SETTINGS.era_cutoff, SETTINGS.outlier_days)
    return made.withColumn("region_id", F.col("oblast"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("r"), "user_id").alias("region_id")).distinct()
    return users.select("region_id", F.upper("region_id").alias("display_name"), F.col("region_id").alias("oblast"), F.lit(PRIMARY_DAYS).alias("primary_train_days"))


def tables(spark: SparkSession, sf_dir: str) -> RegionTables:
    return build_tables(events(spark, sf_dir), regions(spark, sf_dir), SETTINGS, DATA_CUTOFF)
