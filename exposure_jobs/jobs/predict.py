"""Latest (or a given) origin → probabilities for each region and horizon."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from exposure_jobs.config import Settings
from exposure_jobs.operators.features import matrix_features
from exposure_jobs.operators.forecast import forecast
from exposure_jobs.sources.alerts import load_models, read_by_region
from exposure_jobs.sources.publication import current, read_published
from exposure_jobs.sources.regions import check_regions, registry


def main(argv: list[str] | None = None) -> None:
    asked = argparse.ArgumentParser(description=__doc__)
    asked.add_argument("matrix")
    asked.add_argument("models")
    asked.add_argument("out")
    asked.add_argument("--at", default="latest")
    asked.add_argument("--region", action="append")
    asked.add_argument("--published", action="store_true", help="MATRIX and MODELS are published roots; models of another matrix, or other features, are refused")
    given = asked.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    wanted = check_regions(given.region) if given.region else None
    if given.published:
        matrix = read_published(spark, given.matrix, "matrix", wanted)
        facts = {"matrix_version": current(spark, given.matrix)["version"], "features": ",".join(matrix_features(matrix.columns))}
        parameters, calibrators = (read_published(spark, given.models, name, wanted, **facts) for name in ("parameters", "calibrators"))
    else:
        matrix = read_by_region(spark, given.matrix, wanted)
        parameters, calibrators = (load_models(spark, f"{given.models}/{name}", wanted) for name in ("parameters", "calibrators"))
    made = forecast(matrix, parameters, calibrators, registry(spark), matrix_features(matrix.columns), Settings().display_timezone, given.at)
    made.orderBy("region_id", "horizon").write.mode("overwrite").json(given.out)


if __name__ == "__main__":
    main()
