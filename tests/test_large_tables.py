"""What is dealt out must stay as small as the intervals: plans and equalities that hold for tables of any size."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposure_jobs.config import Settings
from exposure_jobs.functions.solvers import newton_logistic, newton_logistic_many, pool_adjacent_violators
from exposure_jobs.jobs import driver_queries, fixed_queries
from exposure_jobs.jobs.process import build_tables
from exposure_jobs.operators import baselines, features, intervals, model, panel, qc
from exposure_jobs.sources.regions import registry
from tests.test_pooled_jobs import random_intervals

SMALL = "/root/testdata/sf0.001"
INTERVALS = "region_id string, started_at timestamp, finished_at timestamp"


@pytest.fixture(scope="module")
def tables(spark):
    rows = random_intervals(5, ["kyiv_city", "lvivska_oblast"], 110, 100, 600) + [("odeska_oblast", a, b) for _, a, b in random_intervals(6, ["x"], 1, 90, 60)]
    return build_tables(spark.createDataFrame(rows, INTERVALS), registry(spark), Settings(horizons=(1, 6, 24), validation_weeks=2, test_weeks=1))


def above_the_hours(df) -> str:
    """The plan's operators on hours: all above the one that unfolds stretches of them."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.split("Generate explode(sequence(")[0]


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+\([^)]*\))", plan)


#: By the finding: queries whose rows by hour go through no exchange at all.
LOCAL = {
    "F22": "average_precision",
    "F27": "monotone_forecast",
    "F3": "baseline_predictions",
    "F5": "baseline_scores",
    "F1": "average_precision_all",
    "F4": "baseline_predictions_all",
    "F2": "baseline_log_loss",
    "F23": "brier_uplift_all",
    "F7": "brier_uplift",
    "F20": "x_type_union",
    "F21": "x_type_union_all",
    "F6": "baseline_scores_all",
}
#: And those that only exchange what was summed up over regions.
SUMMED = {
    "F12": "false_alarm_threshold",
    "F11": "era_scores_all",
    "F10": "era_scores",
    "F9": "calibration_error_all",
    "F8": "calibration_error",
}


@pytest.mark.parametrize("name", LOCAL.values())
def test_hours_are_not_dealt_out_again(spark, name):
    assert exchanges(above_the_hours(driver_queries.QUERIES[name](spark, SMALL))) == []


@pytest.mark.parametrize("name", SUMMED.values())
def test_only_sums_over_regions_are_dealt_out(spark, name):
    found = exchanges(above_the_hours(driver_queries.QUERIES[name](spark, SMALL)))
    assert 0 < len(found) < 4 and not any("region_id" in x for x in found)


def test_labels_are_checked_an_hour_a_row(spark):
    plan = driver_queries.QUERIES["qc_label_mismatches"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = exchanges(plan)
    assert dealt and not any("horizon" in x for x in dealt)


def test_labels_of_other_values_are_reported(spark, tables):
    wrong = tables.origins.withColumn("y_6", F.when(F.hour("origin_hour") == 3, 3 - F.col("y_6")).otherwise(F.col("y_6")))
    found = qc.label_mismatches(wrong, tables.merged).collect()
    assert {r.horizon for r in found} == {6} and all(r.y == 3 - r.want for r in found) and len(found) == wrong.filter(F.hour("origin_hour") == 3).count()


def test_one_pass_predicts_what_two_passes_do(tables):
    matrix = tables.matrix.cache()
    for split in ("test", "validation"):
        names = [c for b in baselines.NAMES for c in (f"pred_{b}_y_1", f"pred_{b}_y_24")]
        wanted = baselines.predict_baselines(baselines.fit_baselines(matrix), matrix.filter(F.col("split") == split), [1, 24])
        made = baselines.train_and_predict(matrix, [1, 24], split)
        of = lambda df: sorted(map(tuple, df.select("region_id", "origin_hour", "y_1", "y_24", *names).collect()))
        assert of(made) == of(wanted) and made.count() > 300
    with pytest.raises(ValueError):
        baselines.train_and_predict(matrix, [1], "train")
    with pytest.raises(ValueError):
        baselines.train_and_predict(matrix, [1], "test", ("best",))


def test_features_of_dealt_hours_are_those_of_blocks(tables):
    lags = Settings().lag_hours
    blocks = features.feature_matrix(tables.origins, tables.merged, lags, "Europe/Kyiv", block_hours=100)
    of = lambda df: sorted((tuple(-1 if v is None else v for v in r) for r in df.select("region_id", "origin_hour", *features.feature_columns(lags)).collect()))
    assert of(tables.features) == of(blocks)


def test_ranges_without_intervals_have_hours_too(spark):
    merged = intervals.merge_intervals(spark.createDataFrame(random_intervals(3, ["a"], 3, 2, 60), INTERVALS))
    ranges = spark.sql("SELECT r AS region_id, timestamp'2023-12-31 20:00:00' AS range_start, timestamp'2024-01-05 00:00:00' AS range_end FROM VALUES ('a'), ('b') t(r)")
    made = panel.exposure_panel(merged, (1, 24), ranges, mask_incomplete=True)
    counts = {r.region_id: (r.n, r.hours, r.hit, r.open) for r in made.groupBy("region_id").agg(F.count("*").alias("n"), F.count_distinct("origin_hour").alias("hours"), F.sum("y_24").alias("hit"), F.sum(F.col("y_24").isNull().cast("int")).alias("open")).collect()}
    assert counts["a"][:2] == counts["b"][:2] == (100, 100) and counts["a"][2] > 0 and counts["b"][2:] == (0, 24)
    assert qc.label_mismatches(made, merged).count() == 0


def test_labels_fitted_together_are_those_fitted_apart():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 6)), (rng.random((300, 9)) < np.linspace(0.02, 0.9, 9)).astype(float)
    weight = np.where(y == 1, 3.0, 1.0) * rng.choice([0.25, 1.0], (300, 1))
    coefs, free = newton_logistic_many(x, y, weight)
    for j in range(9):
        w, b = newton_logistic(x, y[:, j], weight[:, j])
        assert np.allclose([*coefs[j], free[j]], [*w, b], rtol=0, atol=1e-7)


def test_calibrators_come_from_counts(spark):
    rng = np.random.default_rng(6)
    rows = [("a", k, float(np.round(p, 1 + k)), int(rng.random() < p)) for k in (1, 2) for p in rng.random(400)] + [("b", 1, 0.5, 1)] * 5
    made = {(r.region_id, r.horizon): r for r in model.fit_calibrators(spark.createDataFrame(rows, "region_id string, horizon int, p double, y int")).collect()}
    assert made["b", 1].method == "identity" and len(made) == 3
    for k in (1, 2):
        p, y = (np.array([r[i] for r in rows if r[0] == "a" and r[1] == k], float) for i in (2, 3))
        x, level = pool_adjacent_violators(p, y)
        assert np.allclose(np.interp(x, made["a", k].knots_x, made["a", k].knots_y), level)


def test_calibrators_meet_parameters_not_predictions(spark, tables):
    matrix, given, bent, _ = fixed_queries._given(spark, SMALL)
    rows = matrix.filter("split = 'test'")
    one = model.predict_raw(rows, given, fixed_queries.NAMES, calibrators=bent)
    two = model.calibrated(model.predict_raw(rows, given, fixed_queries.NAMES), bent)
    of = lambda df: sorted((r[0], r[1], r[2], round(r[3], 12)) for r in df.collect())
    assert of(one) == of(two)
