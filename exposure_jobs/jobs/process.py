"""Raw alerts → merged intervals, labelled origins, features and training matrix, for all regions in one plan."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure_jobs.config import Settings
from exposure_jobs.functions.timing import hour_to_ts
from exposure_jobs.operators.clean import canonical_events
from exposure_jobs.operators.features import KEYS, feature_columns, hour_features, matrix_features, repeated_keys
from exposure_jobs.operators.intervals import data_cutoffs, merged_intervals
from exposure_jobs.operators.panel import exposure_columns, label_columns, region_hours, region_ranges
from exposure_jobs.operators.qc import label_mismatches, negative_durations, overlapping_intervals
from exposure_jobs.operators.splits import split_boundaries, split_columns
from exposure_jobs.sources.alerts import manifest, read_raw_alerts, write_by_region
from exposure_jobs.sources.lineage import checked_raw, row_digest, run_facts, write_raw_manifest
from exposure_jobs.sources.publication import publish
from exposure_jobs.sources.regions import attach_region, registry, unmapped


@dataclass
class RegionTables:
    events: DataFrame
    merged: DataFrame
    boundaries: DataFrame
    origins: DataFrame
    features: DataFrame
    matrix: DataFrame


def build_tables(events: DataFrame, train_days: DataFrame, settings: Settings, data_cutoff: str | None = None) -> RegionTables:
    """Events with ``region_id`` → all tables, lazily. The merged intervals are cached; origins, features and matrix are columns of the
    same hours, one row an hour throughout, so nothing is joined hour by hour."""
    merged = merged_intervals(events, data_cutoff, settings.outlier_days).cache()
    boundaries = split_boundaries(data_cutoffs(merged), settings.validation_weeks, settings.test_weeks)
    ranges = region_ranges(merged).join(boundaries, "region_id").join(train_days.select("region_id", "primary_train_days"), "region_id", "left")
    flags = exposure_columns(settings.horizons)
    at = hour_to_ts("h")
    hours = region_hours(merged, ranges).withColumns({"origin_hour": at} | flags | split_columns(at))
    origins = [*KEYS, *flags, "split", "in_primary_train"]
    made = hour_features(hours, settings.lag_hours, settings.display_timezone)
    features = [*KEYS, *feature_columns(settings.lag_hours)]
    matrix = made.select(*features, *(c for c in origins if c not in (*KEYS, "active", "active_at_origin")))
    return RegionTables(events, merged, boundaries, hours.select(*origins), made.select(*features), matrix)


def quality_errors(tables: RegionTables, labels: bool = False) -> DataFrame:
    """``(check, region_id, n)`` of what is wrong with a run's tables, empty when all is well: events that end before they start, merged
    intervals that overlap, origins that stand twice in the matrix, and with ``labels`` those that differ from a recomputation."""
    counted = lambda rows, check: rows.groupBy("region_id").agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), "region_id", "n")
    found = counted(negative_durations(tables.events), "negative duration")
    found = found.union(counted(overlapping_intervals(tables.merged), "overlapping intervals")).union(counted(repeated_keys(tables.matrix), "repeated origin"))
    return found.union(counted(label_mismatches(tables.origins, tables.merged), "wrong label")) if labels else found


def main(argv: list[str] | None = None) -> None:
    asked = argparse.ArgumentParser(description=__doc__)
    asked.add_argument("raw")
    asked.add_argument("out")
    asked.add_argument("--data-cutoff")
    asked.add_argument("--raw-manifest", help="a manifest that the feed must agree with")
    asked.add_argument("--check-labels", action="store_true", help="recompute every label by its definition before writing")
    asked.add_argument("--publish", action="store_true", help="also publish the tables as one version, under OUT/published")
    given = asked.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings, regions = Settings(), registry(spark)
    raw = checked_raw(spark, read_raw_alerts(spark, given.raw), given.raw, given.raw_manifest)
    canonical = canonical_events(raw, settings.era_cutoff, settings.outlier_days)
    events = attach_region(canonical, regions)
    tables = build_tables(events, regions, settings, given.data_cutoff)
    names = ("merged", "origins", "features", "matrix")
    for name in names:
        write_by_region(getattr(tables, name), f"{given.out}/{name}")
    tables.merged.unpersist()
    # checks read what was written; a run that fails them gets no manifest and is not published
    written = {name: spark.read.parquet(f"{given.out}/{name}") for name in names}
    tables = replace(tables, **written)
    if wrong := quality_errors(tables, given.check_labels).limit(20).collect():
        raise ValueError("; ".join(f"{r['check']}: {r['n']} in {r['region_id']}" for r in wrong))
    digest = row_digest(raw)
    facts = run_facts(digest, label_columns(tables.matrix.columns), matrix_features(tables.matrix.columns), settings.validation_weeks, settings.test_weeks)
    counts = manifest(tables.merged, tables.origins.drop("active_at_origin"), tables.boundaries, given.raw)
    counts.crossJoin(F.broadcast(facts)).write.mode("overwrite").json(f"{given.out}/manifest")  # facts are one row
    write_raw_manifest(spark, raw, given.raw, f"{given.out}/raw_manifest")
    unmapped(canonical, regions).write.mode("overwrite").json(f"{given.out}/unmapped")
    if given.publish:
        publish(f"{given.out}/published", written, {"raw_digest": digest.first()["row_digest"], "features": ",".join(matrix_features(tables.matrix.columns))})


if __name__ == "__main__":
    main()
