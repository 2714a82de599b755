"""Training matrix → models, calibrators and test metrics."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure_jobs.config import Settings
from exposure_jobs.operators.baselines import long_predictions, train_and_predict
from exposure_jobs.operators.features import matrix_features
from exposure_jobs.operators.metrics import evaluate
from exposure_jobs.operators.model import fit_calibrators, fit_exposure_models, predict_raw
from exposure_jobs.operators.panel import label_columns
from exposure_jobs.operators.pooled import as_one_region, fit_calibrators_distributed, fit_distributed
from exposure_jobs.sources.alerts import read_by_region, save_models, write_report
from exposure_jobs.sources.publication import current, publish, read_published


def train(matrix: DataFrame, method: str = "isotonic", constant_single_class: bool = False, by_sums: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parameters fitted on primary-train rows, calibrators on validation rows; a matrix without validation rows is an error.

    ``by_sums`` is for regions of any number of rows, one region above all: no group meets in one task, with the same results.
    """
    features = matrix_features(matrix.columns)
    horizons = [int(c[2:]) for c in label_columns(matrix.columns)]
    validation = _some(matrix, "validation")
    fit, calibrate = (fit_distributed, fit_calibrators_distributed) if by_sums else (fit_exposure_models, fit_calibrators)
    parameters = fit(matrix, constant_single_class=constant_single_class).cache()
    return parameters, calibrate(predict_raw(validation, parameters, features, horizons), method).cache()


def _some(matrix: DataFrame, split: str) -> DataFrame:
    rows = matrix.filter(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"no {split} rows")
    return rows


def report(matrix: DataFrame, parameters: DataFrame, calibrators: DataFrame, baselines: tuple[str, ...] = ("persistence", "seasonal", "marginal")) -> DataFrame:
    """Model and baselines on the test rows: all metrics, and the uplift over each baseline beside the model's row. A matrix without
    test rows, or without train rows for the baselines, is an error."""
    features = matrix_features(matrix.columns)
    horizons = [int(c[2:]) for c in label_columns(matrix.columns)]
    test = _some(matrix, "test")
    _some(matrix, "train")
    model = predict_raw(test, parameters, features, horizons, calibrators).withColumn("predictor", F.lit("model"))
    based = long_predictions(train_and_predict(matrix, horizons, "test", baselines), horizons, baselines)
    scores = evaluate(model.select(*based.columns).unionByName(based))
    own = F.max(F.when(F.col("predictor") == "model", F.col("brier_score"))).over(Window.partitionBy("region_id", "horizon"))
    return scores.withColumn("__own", own).filter("__own IS NOT NULL").withColumn("model_uplift", F.col("brier_score") - F.col("__own")).drop("__own")


def report_header(matrix: DataFrame, method: str = "isotonic") -> DataFrame:
    """``region_id, train_rows, validation_rows, test_rows, feature_count, calibration_method``: what a region's report rests on."""
    count = lambda rows: F.sum(F.when(rows, 1).otherwise(0)).cast("bigint")
    counts = matrix.groupBy("region_id").agg(count(F.col("in_primary_train")).alias("train_rows"), *(count(F.col("split") == s).alias(f"{s}_rows") for s in ("validation", "test")))
    return counts.withColumns({"feature_count": F.lit(len(matrix_features(matrix.columns))), "calibration_method": F.lit(method)})


def report_table(scores: DataFrame, header: DataFrame) -> DataFrame:
    """The report as lines, ``(region_id, line_number, line)``: first what it rests on, then a line for each horizon with the Brier
    scores of model and baselines."""
    top = header.select("region_id", F.lit(0).alias("line_number"), F.format_string("%s: %d train, %d validation, %d test rows, %d features, %s", "region_id", "train_rows", "validation_rows", "test_rows", "feature_count", "calibration_method").alias("line"))
    brier = lambda name: F.coalesce(F.format_number(F.max(F.when(F.col("predictor") == name, F.col("brier_score"))), 3), F.lit("-"))
    each = F.concat_ws("  ", F.concat(F.lit("+"), F.col("horizon"), F.lit("h")), *(F.concat(F.lit(f"{n} "), brier(n)) for n in ("model", "persistence", "seasonal", "marginal")))
    lines = scores.groupBy("region_id", "horizon").agg(each.alias("line")).select("region_id", F.col("horizon").alias("line_number"), "line")
    return top.unionByName(lines).orderBy("region_id", "line_number")


def main(argv: list[str] | None = None) -> None:
    asked = argparse.ArgumentParser(description=__doc__)
    asked.add_argument("matrix")
    asked.add_argument("out")
    asked.add_argument("--calibration", default=Settings().calibration)
    asked.add_argument("--constant-single-class", action="store_true", help="a horizon whose labels are all alike gets a constant model, not an error")
    asked.add_argument("--pooled", action="store_true", help="one model for all regions, fitted by sums over all rows")
    asked.add_argument("--publish", action="store_true", help="MATRIX is a published root; models and report are published together, as one version of it, under OUT")
    given = asked.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    matrix = (read_published(spark, given.matrix, "matrix") if given.publish else read_by_region(spark, given.matrix)).cache()
    if given.pooled:
        matrix = as_one_region(matrix)
    parameters, calibrators = train(matrix, given.calibration, given.constant_single_class, given.pooled)
    scores, header = report(matrix, parameters, calibrators), report_header(matrix, given.calibration)
    if given.publish:
        facts = model_facts(current(spark, given.matrix)["version"], matrix_features(matrix.columns), given.calibration)
        publish(given.out, {"parameters": parameters, "calibrators": calibrators, "scores": scores, "header": header}, facts)
        return
    save_models(parameters, f"{given.out}/parameters")
    save_models(calibrators, f"{given.out}/calibrators")
    write_report(scores, header, f"{given.out}/report")


def model_facts(matrix_version: str, features: list[str], method: str) -> dict[str, str]:
    """What models must agree with where they are used: the matrix they were fitted on, its features, their calibration."""
    return {"matrix_version": matrix_version, "features": ",".join(features), "method": method}


if __name__ == "__main__":
    main()
