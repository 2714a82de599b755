"""Reading the raw feed; writing and reading the processed tables, the manifest, the report and the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RAW_COLUMNS = ["oblast", "raion", "hromada", "level", "started_at", "finished_at", "source"]
RAW_SCHEMA = StructType([StructField(c, StringType()) for c in RAW_COLUMNS])


def read_raw_alerts(spark: SparkSession, path: str, fmt: str = "csv", oblasts: list[str] | None = None) -> DataFrame:
    """The raw feed as text columns. A CSV header that is not RAW_COLUMNS in that order fails the read; ``oblasts`` is pushed to the scan."""
    if fmt == "csv":
        found = spark.read.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    else:
        found = spark.read.format(fmt).load(path).select(*(F.col(c).cast("string").alias(c) for c in RAW_COLUMNS))
    return found if oblasts is None else found.filter(F.col("oblast").isin(oblasts))


def write_by_region(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder for each region; only the regions written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_id").format(fmt).save(path)


def read_by_region(spark: SparkSession, path: str, regions: list[str] | None = None) -> DataFrame:
    """A table written by region; asked regions prune partitions, and one that is missing is an error."""
    found = spark.read.parquet(path)
    if regions is None:
        return found
    found = found.filter(F.col("region_id").isin(regions))
    there = {r.region_id for r in found.select("region_id").distinct().limit(len(regions) + 1).collect()}
    if missing := sorted(set(regions) - there):
        raise FileNotFoundError(f"no rows for {missing} in {path}")
    return found


def manifest(merged: DataFrame, origins: DataFrame, boundaries: DataFrame, source: str) -> DataFrame:
    """Lineage and counts of each region, one row each."""
    intervals = merged.groupBy("region_id").agg(F.count("*").alias("interval_count"))
    hours = origins.groupBy("region_id").agg(F.count("*").alias("origin_count"), F.sum("active").alias("active_origin_count"), F.min("origin_hour").alias("range_start"), F.max("origin_hour").alias("range_end"))
    joined = hours.join(intervals, "region_id", "full").join(boundaries, "region_id", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("interval_count", "origin_count", "active_origin_count")}
    return joined.withColumns(counts).withColumn("columns", F.lit(",".join(origins.columns))).withColumn("source", F.lit(source))


def write_report(metrics: DataFrame, header: DataFrame, path: str) -> None:
    """Metrics nested by region beside what they rest on, as JSON lines."""
    rest = [c for c in metrics.columns if c != "region_id"]
    metrics.groupBy("region_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("horizons")).join(header, "region_id").write.mode("overwrite").json(path)


def read_raw_manifest(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Column list and row count that a raw feed's JSON manifest (``columns``, ``row_count``) states."""
    row = spark.read.option("multiLine", True).json(path).select("columns", F.col("row_count").cast("bigint")).first()
    return list(row[0]), row[1]


save_models, load_models = write_by_region, read_by_region
