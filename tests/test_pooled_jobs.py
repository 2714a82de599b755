"""Groups of any size: pooled medians, fits, calibration and scores; merges and features in pieces of a region."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposure_jobs.config import Settings
from exposure_jobs.functions.solvers import pool_adjacent_violators, pool_blocks
from exposure_jobs.jobs.process import build_tables
from exposure_jobs.operators import features, intervals, metrics, model, panel, pooled
from exposure_jobs.sources.regions import registry


def random_intervals(seed, regions, n, days, longest_minutes):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    rows = []
    for r in regions:
        for _ in range(n):
            a = start + timedelta(minutes=rng.randrange(days * 1440))
            rows.append((r, a, a + timedelta(minutes=rng.choice([0, 5, 90, rng.randrange(longest_minutes)]))))
    return rows


@pytest.fixture(scope="module")
def matrix(spark):
    rows = random_intervals(4, ["kyiv_city", "lvivska_oblast"], 110, 100, 600)
    events = spark.createDataFrame(rows, "region_id string, started_at timestamp, finished_at timestamp")
    return build_tables(events, registry(spark), Settings(horizons=(1, 6, 24), validation_weeks=2, test_weeks=1)).matrix.cache()


def test_merging_crosses_months_without_a_window_over_the_region(spark):
    rows = random_intervals(7, ["a", "b"], 60, 200, 60 * 24 * 50)
    rows += [("c", datetime(2024, 1, 5), datetime(2024, 6, 1)), ("c", datetime(2024, 2, 5), datetime(2024, 2, 6)), ("c", datetime(2024, 4, 1), datetime(2024, 7, 1)), ("c", datetime(2024, 7, 1), datetime(2024, 7, 2)), ("c", datetime(2024, 7, 3), datetime(2024, 7, 3))]
    found = intervals.merge_intervals(spark.createDataFrame(rows, "region_id string, started_at timestamp, finished_at timestamp")).collect()
    want = []
    for region in "abc":
        end = None
        for _, a, b in sorted(r for r in rows if r[0] == region):
            if end is None or a > end:
                want.append([region, a, b])
                end = b
            else:
                end = want[-1][2] = max(end, b)
    assert sorted((r.region_id, r.started_at, r.finished_at) for r in found) == sorted(map(tuple, want))


def test_features_in_blocks_are_those_of_one_window(spark):
    merged = intervals.merge_intervals(spark.createDataFrame(random_intervals(9, ["a"], 40, 40, 900), "region_id string, started_at timestamp, finished_at timestamp"))
    hours = panel.exposure_panel(merged, (1,))
    of = lambda block: sorted(map(tuple, features.feature_matrix(hours, merged, (1, 6, 168), "Europe/Kyiv", block_hours=block).collect()))
    assert of(48) == of(1_000_000) == of(7) and len(of(48)) == hours.count()
    cut = features.feature_matrix(hours, merged, (1, 6), "Europe/Kyiv", block_hours=48)
    assert "hashpartitioning(region_id" in cut._jdf.queryExecution().executedPlan().toString() and "block" in cut._jdf.queryExecution().executedPlan().toString()


def test_exact_medians(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v) if rng.random() > 0.1 else None, None, int(v)) for k, n in (("even", 200), ("odd", 201), ("one", 1)) for v in rng.integers(-20, 20, n)]
    table = spark.createDataFrame(rows, "k string, a double, nothing double, b long").repartition(5)
    found = {(r.k, r.feature): r.median for r in pooled.exact_medians(table, ["k"], ["a", "nothing", "b"]).collect()}
    for k in ("even", "odd", "one"):
        for name, i in (("a", 1), ("b", 3)):
            values = [r[i] for r in rows if r[0] == k and r[i] is not None]
            assert (k, name) not in found if not values else found[k, name] == np.median(values)
        assert (k, "nothing") not in found


@pytest.mark.parametrize("older", [None, 0.25])
def test_fits_by_sums_equal_fits_in_one_task(matrix, older):
    for rows in (matrix, pooled.as_one_region(matrix)):
        plain, spread = ({(r.region_id, r.horizon): r for r in f(rows, older_weight=older, constant_single_class=True).collect()} for f in (model.fit_exposure_models, pooled.fit_distributed))
        assert plain.keys() == spread.keys()
        for key, r in plain.items():
            other = spread[key]
            assert (r.status, r.n_fit, list(r.features)) == (other.status, other.n_fit, list(other.features))
            assert np.allclose([*r.coefs, r.intercept, *r.medians, *r.means, *r.scales], [*other.coefs, other.intercept, *other.medians, *other.means, *other.scales], rtol=0, atol=1e-7)


def test_pooled_fit_has_no_gradient_left_and_refuses_one_class(matrix):
    rows = pooled.as_one_region(matrix).filter("in_primary_train").cache()
    steepest = [r.steepest for r in model.gradients(rows, pooled.fit_distributed(rows)).collect()]
    assert len(steepest) == 3 and max(steepest) < 1e-5
    with pytest.raises(ValueError, match="y_6: the labels are all alike"):
        pooled.fit_distributed(rows.withColumn("y_6", F.lit(1)))


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibrators_by_parts_equal_those_of_one_task(spark, method):
    rng = np.random.default_rng(11)
    rows = []
    for key, n in (("big", 4000), ("small", 30), ("alike", 5)):
        p = np.round(rng.random(n), 3) if key != "small" else rng.random(n)
        rows += [(key, 6, float(x), 1 if key == "alike" else int(rng.random() < x * x)) for x in p]
    table = spark.createDataFrame(rows, "region_id string, horizon int, p double, y int").repartition(6)
    one, parts = ({r.region_id: r for r in f(table, method).collect()} for f in (model.fit_calibrators, pooled.fit_calibrators_distributed))
    assert {k: r.method for k, r in one.items()} == {k: r.method for k, r in parts.items()} == {"big": method, "small": method, "alike": "identity"}
    for k in one:
        assert np.allclose(one[k].knots_x, parts[k].knots_x, atol=1e-7) and np.allclose(one[k].knots_y, parts[k].knots_y, atol=1e-7)


def test_pooling_pooled_blocks_is_pooling_all():
    rng = np.random.default_rng(2)
    x, y = np.arange(300.0), (rng.random(300) < np.linspace(0, 1, 300)).astype(float)
    parts = [pool_blocks(x[a:b], x[a:b], np.ones(b - a), y[a:b]) for a, b in ((0, 70), (70, 71), (71, 220), (220, 300))]
    low, high, n, hits = pool_blocks(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    _, level = pool_adjacent_violators(x, y)
    assert np.allclose(np.repeat(hits / n, (high - low + 1).astype(int)), level)


def test_scores_over_ranges_equal_those_of_one_window(spark):
    rng = np.random.default_rng(8)
    rows = [("m" if i % 5 else "n", float(np.round(p, 2)), int(rng.random() < p)) for i, p in enumerate(rng.random(2000))] + [("no", 0.5, 0), ("no", 0.25, 0)]
    table = spark.createDataFrame(rows, "predictor string, p double, y int").repartition(5).cache()
    for f in (metrics.average_precision, metrics.evaluate, lambda t, k, spread=False: metrics.false_alarm_threshold(t, k, 0.1, spread)):
        one, ranges = (sorted(f(table, ["predictor"], spread=s).collect()) for s in (False, True))
        assert len(one) == len(ranges) == 3
        for a, b in zip(one, ranges, strict=True):
            assert a[0] == b[0] and np.allclose([v if v is not None else -9 for v in a[1:]], [v if v is not None else -9 for v in b[1:]], equal_nan=True)
