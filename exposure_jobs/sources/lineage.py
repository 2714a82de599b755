"""What a raw feed was when it was processed: digests of its files and rows, kept in the run's manifest and checked when it is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure_jobs.operators.qc import validate_raw

FILE_COLUMNS = ["path", "length", "sha256"]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of each file of the feed, hashed where it is read; a file is one row, of 2 GB at most."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_token(columns: list[str]) -> Column:
    """A row as one text that tells its fields apart, null from empty too."""
    return F.concat(*(F.coalesce(F.concat(F.octet_length(c), F.lit(":"), F.col(c), F.lit(";")), F.lit("-;")) for c in columns))


def row_digest(raw: DataFrame) -> DataFrame:
    """One row ``(row_count, row_digest)``: the sum over rows of 60 bits of each one's SHA-256, so that neither order nor files count but
    every row and its repeats do. It is summed before the shuffle; what meets in one task is a number from each."""
    part = F.conv(F.substring(F.sha2(row_token(raw.columns).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return raw.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("row_digest"))


def write_raw_manifest(spark: SparkSession, raw: DataFrame, path: str, out: str) -> None:
    """The feed's manifest as one JSON row: ``columns, row_count, row_digest, files``. ``raw`` is what was read from ``path``."""
    files = file_digests(spark, path).groupBy().agg(F.sort_array(F.collect_list(F.struct(*FILE_COLUMNS))).alias("files"))  # a few words a file
    row_digest(raw).crossJoin(files).withColumn("columns", F.array(*map(F.lit, raw.columns))).write.mode("overwrite").json(out)


def raw_differences(spark: SparkSession, raw: DataFrame, path: str, manifest: str, tolerance: float = 0.01) -> DataFrame:
    """``(check, detail)`` of where the feed differs from its manifest: header, row count beyond the tolerance, files that changed, went
    or came, rows. A manifest that states no files or digest (as a feed's publisher writes it) is held to its header and count alone."""
    stated = spark.read.option("multiLine", False).json(manifest)
    row = stated.first()
    found = validate_raw(raw, list(row["columns"]), int(row["row_count"]), tolerance)
    if "row_digest" in stated.columns:
        now = row_digest(raw).filter(F.col("row_digest") != row["row_digest"])
        found = found.union(now.select(F.lit("rows").alias("check"), F.concat(F.lit(f"digest {row['row_digest']} was stated, now "), "row_digest").alias("detail")))
    if "files" in stated.columns:
        before = stated.select(F.explode("files").alias("f")).select("f.path", F.col("f.sha256").alias("was"))
        both = before.join(file_digests(spark, path).select("path", "sha256"), "path", "full").filter(~F.col("was").eqNullSafe(F.col("sha256")))
        change = F.when(F.col("was").isNull(), "came").when(F.col("sha256").isNull(), "went").otherwise("changed")
        found = found.union(both.select(F.lit("file").alias("check"), F.concat_ws(" ", change, "path").alias("detail")))
    return found


def checked_raw(spark: SparkSession, raw: DataFrame, path: str, manifest: str | None) -> DataFrame:
    """``raw``, or an error that says where it differs from its manifest."""
    if manifest is not None and (wrong := raw_differences(spark, raw, path, manifest).limit(20).collect()):
        raise ValueError("; ".join(f"{r['check']}: {r['detail']}" for r in wrong))
    return raw


def run_facts(raw_facts: DataFrame, labels: list[str], features: list[str], validation_weeks: int, test_weeks: int) -> DataFrame:
    """One row of what a run rests on beside the counts by region: ``row_digest``'s columns, windows, labels and features."""
    more = {"validation_weeks": F.lit(validation_weeks), "test_weeks": F.lit(test_weeks), "labels": F.lit(",".join(labels)), "features": F.lit(",".join(features))}
    renamed = raw_facts.select(F.col("row_count").alias("raw_rows"), F.col("row_digest").alias("raw_digest"))
    return renamed.withColumns(more)


