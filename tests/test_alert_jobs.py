"""Hand values, brute force on random intervals, and invariants of the alert-data jobs."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposure_jobs.config import Settings
from exposure_jobs.functions.solvers import newton_logistic, pool_adjacent_violators
from exposure_jobs.functions.timing import micros
from exposure_jobs.jobs import train
from exposure_jobs.jobs.process import build_tables
from exposure_jobs.operators import baselines, features, forecast, intervals, metrics, model, panel, qc, splits
from exposure_jobs.operators.clean import canonical_events
from exposure_jobs.sources import alerts
from exposure_jobs.sources import regions as registry_module
from exposure_jobs.sources.alerts import RAW_COLUMNS, RAW_SCHEMA, read_by_region, read_raw_alerts, write_by_region
from exposure_jobs.sources.regions import attach_region, registry, slugify

UTC = timezone.utc
H = timedelta(hours=1)

RAW = [
    ("Kyiv City", None, None, "oblast", "2024-06-01 08:00:00+00:00", "2024-06-01 09:30:00+00:00", "official"),
    ("Kyiv City", None, None, "oblast", "2024-06-01 09:00:00+00:00", "2024-06-01 10:00:00+00:00", "official"),
    ("Kyiv City", None, None, "oblast", "2024-06-01 12:00:00+00:00", "2024-06-01 13:00:00+00:00", "official"),
    ("Kyivska oblast", None, None, "oblast", "2024-06-02 10:00:00+00:00", "2024-06-02 11:00:00+00:00", "official"),
    ("Kyivska oblast", "Kyivskyi raion", None, "raion", "2024-06-02 10:30:00+00:00", "2024-06-02 11:30:00+00:00", "official"),
    ("Kyivska oblast", "Brovary raion", None, "raion", "2025-12-05 04:00:00+00:00", "2025-12-05 06:00:00+00:00", "official"),
    ("Kyivska oblast", "Boryspil raion", None, "raion", "2025-12-05 04:00:00+00:00", "2025-12-05 06:00:00+00:00", "official"),
    ("Vinnytska oblast", None, None, "oblast", "2024-06-03 10:00:00+00:00", "2024-06-03 11:00:00+00:00", "official"),
]


@pytest.fixture(scope="module")
def events(spark):
    return canonical_events(spark.createDataFrame(RAW, RAW_SCHEMA))


@pytest.fixture(scope="module")
def tables(spark, events):
    regions = registry(spark)
    return build_tables(attach_region(events, regions), regions, Settings())


def us(t):
    return int((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))


def frame(spark, rows):
    return spark.createDataFrame([(r, a, b) for r, a, b in rows], "region_id string, a long, b long").select("region_id", F.timestamp_micros("a").alias("started_at"), F.timestamp_micros("b").alias("finished_at"))


def test_ids_and_eras(events):
    rows = events.collect()
    assert [r.alert_id for r in rows] == ["cf14390e890ae749", "1d1664df2cb01b9d", "07e8712df4ec9fd8", "635064a31d0d349c", "1c57a4670806b379", "3e8e98cefc4fe307", "0d2872ee4b5fcc6a", "6e7516a785e8c870"]
    assert [r.granularity_era for r in rows] == ["oblast_dominant"] * 4 + ["mixed"] + ["raion_dominant"] * 2 + ["oblast_dominant"]


def test_pipeline_values(tables):
    merged = {(r.region_id, r.started_at, r.finished_at) for r in tables.merged.filter("region_id = 'kyiv_city'").collect()}
    assert {(a.hour, b.hour) for _, a, b in merged} == {(8, 10), (12, 13)}
    rows = tables.matrix.filter("region_id = 'kyiv_city'").orderBy("origin_hour").collect()
    want = [  # at origin, y_1, y_2, sums of 1, 3 and 6 hours, since start, since end, hour, day, hour of week
        (1, 1, 1, 0, 0, 0, 0.0, None, 11, 5, 131), (1, 1, 1, 1, 1, 1, 1.0, None, 12, 5, 132), (0, 0, 1, 1, 2, 2, 2.0, 0.0, 13, 5, 133),
        (0, 1, 1, 0, 2, 2, 3.0, 1.0, 14, 5, 134), (1, 1, 1, 0, 1, 2, 0.0, 2.0, 15, 5, 135), (0, 0, 0, 1, 1, 3, 1.0, 0.0, 16, 5, 136),
    ]
    got = [(r.active_at_origin, r.y_1, r.y_2, r.active_sum_1h, r.active_sum_3h, r.active_sum_6h, r.time_since_last_start_h, r.time_since_last_end_h, r.hour_kyiv, r.dow_kyiv, r.hour_of_week_kyiv) for r in rows]
    assert got == want and all(r.split == "test" and not r.in_primary_train for r in rows)
    other = tables.origins.filter("region_id = 'kyivska_oblast'").agg(F.count("*"), F.sum("active"), *(F.sum(f"y_{k}") for k in (1, 2, 3, 6, 24))).first()
    assert tuple(other) == (13221, 4, 5, 6, 7, 10, 28)
    assert features.repeated_keys(tables.matrix).count() == 0 and qc.label_mismatches(tables.origins.filter("region_id = 'kyiv_city'"), tables.merged).count() == 0


def test_random_intervals_against_brute_force(spark):
    rng, base = random.Random(4), us(datetime(2024, 1, 31, tzinfo=UTC))
    hour = 3_600_000_000
    rows = []
    for region in ("a", "b"):
        for _ in range(60):
            s = base + rng.choice([rng.randrange(0, 90 * hour), rng.randrange(0, 90) * hour])
            rows.append((region, s, s + rng.choice([0, hour, rng.randrange(0, 3 * hour), 30_000_000])))
    merged = intervals.merge_intervals(frame(spark, rows))
    got = {(r.region_id, r.a, r.b) for r in merged.select("region_id", micros("started_at").alias("a"), micros("finished_at").alias("b")).collect()}
    want = set()
    for region in ("a", "b"):
        out = []
        for s, e in sorted((s, e) for r, s, e in rows if r == region):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        want |= {(region, s, e) for s, e in out}
    assert got == want and qc.overlapping_intervals(merged).count() == 0
    for r in panel.exposure_panel(merged, (1, 3, 24)).withColumn("t", micros("origin_hour")).collect():
        own = [(s, e) for x, s, e in want if x == r.region_id]
        assert r.active == any(s < r.t + hour and e > r.t for s, e in own)
        assert r.active_at_origin == any(s <= r.t < e for s, e in own)
        assert (r.y_1, r.y_3, r.y_24) == tuple(any(s <= r.t + n * hour and e > r.t for s, e in own) for n in (1, 3, 24))
        assert r.active_at_origin <= r.y_1 <= r.y_3 <= r.y_24


def test_bad_rows_fail(spark):
    with pytest.raises(Exception, match="ends before it starts"):
        intervals.merged_intervals(frame(spark, [("a", 10, 5)])).collect()
    with pytest.raises(Exception, match="needs a data cutoff"):
        intervals.merged_intervals(frame(spark, [("a", 10, None)])).collect()
    assert intervals.merged_intervals(frame(spark, [("a", 10, None)]), "2024-01-01").count() == 1
    assert panel.hourly_origins(frame(spark, [("a", 10**13, 5)]).toDF("region_id", "range_start", "range_end")).count() == 0


def test_header_is_checked(spark, tmp_path):
    (tmp_path / "good.csv").write_text(",".join(RAW_COLUMNS) + "\nx,,,oblast,2024-01-01 00:00:00,,s\n")
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert read_raw_alerts(spark, str(tmp_path / "good.csv"), oblasts=["x"]).count() == 1
    with pytest.raises(Exception):
        read_raw_alerts(spark, str(tmp_path / "bad.csv")).collect()


def test_registry(spark):
    assert len(registry_module.allowlisted()) == 7
    with pytest.raises(KeyError):
        registry_module.check_regions(["nowhere"])
    with pytest.raises(ValueError):
        registry_module.check_regions(["luhanska_oblast"])
    names = spark.createDataFrame([("Kyivska oblast",), ("Lódź — Été!",), ("  a--b ",)], "n string")
    assert [r.s for r in names.select(slugify(F.col("n")).alias("s")).collect()] == ["kyivska_oblast", "lodz_ete", "a_b"]


def test_split_edges(spark):
    cutoff = datetime(2026, 6, 20, tzinfo=UTC)
    edges = splits.split_boundaries(spark.createDataFrame([("kyiv_city", cutoff)], "region_id string, data_cutoff timestamp"), 8, 4)
    times = [(datetime(2026, 3, 1, tzinfo=UTC), "train"), (datetime(2026, 3, 28, tzinfo=UTC), "train"), (datetime(2026, 4, 15, tzinfo=UTC), "validation"), (datetime(2026, 6, 1, tzinfo=UTC), "test"), (cutoff + H, "holdout"), (datetime(2022, 1, 1, tzinfo=UTC), "train")]
    origins = spark.createDataFrame([("kyiv_city", t) for t, _ in times], "region_id string, origin_hour timestamp")
    rows = {micro: (s, p) for micro, s, p in splits.annotate_splits(origins, edges, registry(spark)).select(micros("origin_hour"), "split", "in_primary_train").collect()}
    assert [rows[us(t)][0] for t, _ in times] == [s for _, s in times]
    assert rows[us(times[0][0])][1] and not rows[us(times[5][0])][1]


def test_baselines_by_hand(spark):
    rows = [("r", datetime(2024, 1, 1, i, tzinfo=UTC), h, a, y, s) for i, (h, a, y, s) in enumerate([(8, 1, 1, "train"), (8, 0, 0, "train"), (9, 1, 1, "train"), (9, 0, 0, "test"), (99, 0, 1, "test")])]
    matrix = spark.createDataFrame(rows, "region_id string, origin_hour timestamp, hour_of_week_kyiv int, active_at_origin int, y_1 int, split string")
    made = baselines.predict_baselines(baselines.fit_baselines(matrix), matrix, [1]).orderBy("origin_hour").collect()
    assert made[0].pred_marginal_y_1 == pytest.approx(2 / 3) and made[3].pred_seasonal_y_1 == 1.0 and made[4].pred_seasonal_y_1 == pytest.approx(2 / 3)
    assert (made[0].pred_persistence_y_1, made[1].pred_persistence_y_1) == (1.0, 0.0)
    with pytest.raises(ValueError):
        baselines.predict_baselines(baselines.fit_baselines(matrix), matrix, [1], ("best",))


def test_metrics_with_ties(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 12, 300) / 11
    rows = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(y, p)], "k string, y int, p double")
    got = metrics.evaluate(rows, ["k"]).first()
    levels = sorted(set(p), reverse=True)
    ap, before = 0.0, 0.0
    for t in levels:
        recall = y[p >= t].sum() / y.sum()
        ap, before = ap + (recall - before) * y[p >= t].mean(), recall
    q = np.clip(p, metrics.EPSILON, 1 - metrics.EPSILON)
    assert got.pr_auc == pytest.approx(ap) and got.brier_score == pytest.approx(((p - y) ** 2).mean())
    assert got.log_loss == pytest.approx(-np.where(y == 1, np.log(q), np.log(1 - q)).mean())
    assert metrics.average_precision(rows, ["k"]).first().pr_auc == pytest.approx(ap)
    perfect = spark.createDataFrame([("k", i % 2, float(i % 2)) for i in range(4)], "k string, y int, p double")
    assert metrics.evaluate(perfect, ["k"]).first().brier_score == 0 and metrics.evaluate(perfect, ["k"]).first().pr_auc == 1


def test_solvers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x @ [1, -2, 0.5] + rng.normal(size=200) > 0).astype(float)
    w, b = newton_logistic(x, y, np.ones(200))
    gradient = np.r_[x.T @ (1 / (1 + np.exp(-x @ w - b)) - y) + w, (1 / (1 + np.exp(-x @ w - b)) - y).sum()]
    assert np.abs(gradient).max() < 1e-6
    with pytest.raises(ValueError):
        newton_logistic(x, np.ones(200), np.ones(200))
    s, t = np.round(rng.random(80), 1), rng.integers(0, 2, 80).astype(float)
    knots, level = pool_adjacent_violators(s, t)
    n, m = np.array([(s == k).sum() for k in knots]), np.array([t[s == k].mean() for k in knots])
    mean = lambda j, k: (n[j : k + 1] * m[j : k + 1]).sum() / n[j : k + 1].sum()
    assert level == pytest.approx([max(min(mean(j, k) for k in range(i, len(knots))) for j in range(i + 1)) for i in range(len(knots))])


def test_train_report_and_forecast(spark, tmp_path):
    rng, start, rows = random.Random(2), datetime(2024, 1, 1, tzinfo=UTC), []
    for region in ("kyiv_city", "lvivska_oblast"):
        at = start
        while at < start + timedelta(days=60):
            length = timedelta(minutes=rng.randrange(10, 200))
            rows.append((region, us(at), us(at + length)))
            at += length + timedelta(minutes=rng.randrange(20, 900))
    settings = Settings(horizons=(1, 6), validation_weeks=2, test_weeks=1)
    matrix = build_tables(frame(spark, rows), registry(spark), settings).matrix
    write_by_region(matrix, f"{tmp_path}/matrix")
    matrix = read_by_region(spark, f"{tmp_path}/matrix", ["kyiv_city", "lvivska_oblast"])
    with pytest.raises(FileNotFoundError):
        read_by_region(spark, f"{tmp_path}/matrix", ["odeska_oblast"])
    for method in ("isotonic", "sigmoid"):
        parameters, calibrators = train.train(matrix, method)
        assert parameters.count() == calibrators.count() == 4
        report = train.report(matrix, parameters, calibrators).collect()
        assert len(report) == 16 and all(0 <= r.brier_score <= 1 for r in report)
        made = forecast.forecast(matrix, parameters, calibrators, registry(spark), features.matrix_features(matrix.columns), "Europe/Kyiv").collect()
        assert len(made) == 4 and all(0 <= r.probability <= 1 and r.display_name for r in made)
    with pytest.raises(Exception, match="not exactly one row"):
        forecast.forecast_rows(matrix, forecast.pick_origins(matrix, "1999-01-01 00:00:00")).collect()
    with pytest.raises(ValueError):
        model.predict_raw(matrix, parameters, ["no_such_feature"])


def test_entry_registers_queries():
    import __spark_entry__

    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and "exposure_rate" in found


@pytest.fixture(scope="module")
def driver_tables(spark, tables):
    """A week of the sample's hourly rows, with a train part, as the registered queries see them."""
    from types import SimpleNamespace

    days = [datetime(2024, 6, 1, tzinfo=UTC) + n * H for n in range(96)]
    rng = random.Random(6)
    rows = []
    for n, t in enumerate(days):
        first = rng.randint(1, 30)  # labels are nested
        rows.append(("a", us(t), n % 168, rng.randint(0, 1), *(int(k >= first) for k in range(1, 25)), "train" if n < 60 else "test", n < 60))
    names = ["region_id", "at", "hour_of_week_kyiv", "active_at_origin", *(f"y_{k}" for k in range(1, 25)), "split", "in_primary_train"]
    made = spark.createDataFrame(rows, names).withColumn("origin_hour", F.timestamp_micros("at")).drop("at")
    return SimpleNamespace(matrix=made.cache(), merged=tables.merged, origins=tables.origins), rows


def test_registered_queries_reach_every_horizon(spark, driver_tables, monkeypatch):
    from exposure_jobs.jobs import driver_queries, testbed

    made, rows = driver_tables
    monkeypatch.setattr(testbed, "tables", lambda s, d: made)
    every = set(range(1, 25))
    rates = driver_queries.QUERIES["baseline_rates_all"](spark, "").filter("kind = 'marginal'").collect()
    train_rows = [r for r in rows if r[-2] == "train"]
    assert {r.horizon: (r.n, r.hits) for r in rates} == {k: (60, sum(r[3 + k] for r in train_rows)) for k in every}
    weights = driver_queries.QUERIES["class_weights_all"](spark, "").collect()
    assert {r.horizon: r.n for r in weights} == dict.fromkeys(every, 60)
    assert {r.horizon for r in driver_queries.QUERIES["monotone_forecast_all"](spark, "").select("horizon").distinct().collect()} == every


def test_a_wrong_label_of_any_horizon_is_reported(spark, tables, monkeypatch):
    from types import SimpleNamespace

    from exposure_jobs.jobs import driver_queries, testbed

    origins = tables.origins.filter("region_id = 'kyiv_city'").withColumn("y_5", 1 - F.col("y_5"))
    monkeypatch.setattr(testbed, "tables", lambda s, d: SimpleNamespace(origins=origins, merged=tables.merged))
    found = driver_queries.qc_label_mismatches(spark, "").collect()
    assert len(found) == origins.count() and {r.horizon for r in found} == {5}


def generated_alerts(regions, days, seed=2):
    rng, start, rows = random.Random(seed), datetime(2024, 1, 1, tzinfo=UTC), []
    for region in regions:
        at = start
        while at < start + timedelta(days=days):
            length = timedelta(minutes=rng.randrange(10, 200))
            rows.append((region, at, at + length))
            at += length + timedelta(minutes=rng.randrange(20, 900))
    return rows


def test_mains_from_feed_to_forecast(spark, tmp_path):
    """process, train and predict on files, as a user starts them."""
    import json

    from exposure_jobs.jobs import predict, process

    lines = [",".join(RAW_COLUMNS)]
    for name, a, b in generated_alerts(["Kyiv City", "Lvivska oblast", "Nowhere"], 120):
        lines.append(f"{name},,,oblast,{a:%Y-%m-%d %H:%M:%S}+00:00,{b:%Y-%m-%d %H:%M:%S}+00:00,official")
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "tables")
    process.main([str(tmp_path / "raw.csv"), out, "--data-cutoff", "2024-05-01 00:00:00"])
    counts = spark.read.json(f"{out}/manifest").collect()
    assert {r.region_id for r in counts} == {"kyiv_city", "lvivska_oblast"} and all(r.interval_count > 0 and r.origin_count > r.active_origin_count for r in counts)
    train.main([f"{out}/matrix", str(tmp_path / "models"), "--constant-single-class"])
    reports = spark.read.json(f"{tmp_path}/models/report").collect()
    assert {r.region_id for r in reports} == {"kyiv_city", "lvivska_oblast"}
    assert all(r.train_rows > 0 and r.validation_rows == 8 * 7 * 24 and r.test_rows == 4 * 7 * 24 and r.feature_count == 12 and r.calibration_method == "isotonic" and len(r.horizons) == 24 * 4 for r in reports)
    predict.main([f"{out}/matrix", str(tmp_path / "models"), str(tmp_path / "forecast"), "--region", "kyiv_city"])
    made = spark.read.json(str(tmp_path / "forecast")).collect()
    assert sorted(r.horizon for r in made) == list(range(1, 25)) and all(0 <= r.probability <= 1 and r.display_name == "Kyiv City" for r in made)
    # saved parameters give what the fitted ones give
    matrix = read_by_region(spark, f"{out}/matrix")
    parameters, _ = train.train(matrix, constant_single_class=True)
    both = [{(r.region_id, r.horizon): (tuple(r.coefs), r.intercept) for r in p.collect()} for p in (parameters, read_by_region(spark, f"{tmp_path}/models/parameters"))]
    assert both[0].keys() == both[1].keys() and all(np.allclose([*both[0][k][0], both[0][k][1]], [*both[1][k][0], both[1][k][1]]) for k in both[0])
    manifest = {"columns": RAW_COLUMNS, "row_count": len(lines) - 1}
    (tmp_path / "raw.json").write_text(json.dumps(manifest))
    columns, rows = alerts.read_raw_manifest(spark, str(tmp_path / "raw.json"))
    raw = read_raw_alerts(spark, str(tmp_path / "raw.csv"))
    assert qc.validate_raw(raw, columns, rows).count() == 0
    assert [r.check for r in qc.validate_raw(raw, columns, 2 * rows).collect()] == ["row_count"]
    assert sorted(r.check for r in qc.validate_raw(raw.drop("source"), columns, 2 * rows).collect()) == ["header", "row_count"]


@pytest.fixture(scope="module")
def small_matrix(spark):
    rows = [(r, us(a), us(b)) for r, a, b in generated_alerts(["kyiv_city"], 60)]
    return build_tables(frame(spark, rows), registry(spark), Settings(horizons=(1, 6, 24), validation_weeks=2, test_weeks=1)).matrix.cache()


def test_missing_splits_are_errors(small_matrix):
    with pytest.raises(ValueError, match="no validation rows"):
        train.train(small_matrix.filter("split <> 'validation'"))
    parameters, calibrators = train.train(small_matrix)
    for split in ("test", "train"):
        with pytest.raises(ValueError, match=f"no {split} rows"):
            train.report(small_matrix.filter(f"split <> '{split}'"), parameters, calibrators)


def test_single_class_horizons(small_matrix):
    alike = small_matrix.withColumn("y_24", F.lit(1))
    with pytest.raises(Exception, match="all alike"):
        model.fit_exposure_models(alike).collect()
    found = {r.horizon: r for r in model.fit_exposure_models(alike, constant_single_class=True).collect()}
    assert set(found) == {1, 6, 24} and found[24].status == "constant" and found[1].status == "fitted"
    parameters, calibrators = train.train(alike, constant_single_class=True)
    made = forecast.forecast(alike, parameters, calibrators, registry(alike.sparkSession), features.matrix_features(alike.columns), "Europe/Kyiv")
    assert {r.horizon: round(r.probability, 6) for r in made.collect()}[24] == 1.0
    lines = [r.line for r in forecast.listing(made).collect()]
    assert len(lines) == 3 and lines[2].startswith("Kyiv City") and lines[2].endswith("+24h  1.00")
    table = train.report_table(train.report(alike, parameters, calibrators), train.report_header(alike)).collect()
    assert [r.line_number for r in table] == [0, 1, 6, 24] and table[0].line.startswith("kyiv_city: ")


def test_gradient_is_zero_at_the_fit_and_not_beside_it(small_matrix):
    matrix = small_matrix.drop("y_24")  # all alike there
    parameters = model.fit_exposure_models(matrix)
    assert all(r.steepest < 1e-6 for r in model.gradients(matrix, parameters).collect())
    beside = parameters.withColumn("intercept", F.col("intercept") + 0.01)
    assert all(r.steepest > 1e-3 for r in model.gradients(matrix, beside).collect())


def test_sigmoid_calibration_and_points_between_knots(spark):
    rng = np.random.default_rng(5)
    p = rng.random(200)
    y = (rng.random(200) < p**2).astype(int)
    rows = spark.createDataFrame([("r", 1, float(a), int(b)) for a, b in zip(p, y)], "region_id string, horizon int, p double, y int")
    asked = spark.createDataFrame([("r", 1, float(x)) for x in np.linspace(-0.2, 1.2, 57)] + [("other", 1, 0.3)], "region_id string, horizon int, p double")
    w, b = newton_logistic(p.reshape(-1, 1), y.astype(float), np.ones(200))
    knots, level = pool_adjacent_violators(p, y.astype(float))
    want = {"sigmoid": lambda x: 1 / (1 + np.exp(-(w[0] * x + b))), "isotonic": lambda x: np.interp(x, knots, level)}
    for method, plain in want.items():
        got = model.calibrated(asked.withColumn("asked", F.col("p")).select("region_id", "horizon", "p", "asked"), model.fit_calibrators(rows, method)).collect()
        for r in got:
            assert r.p == pytest.approx(0.3 if r.region_id == "other" else plain(np.clip(r.asked, 0, 1)))


def test_running_aggregates_cross_ranges(spark):
    import random

    from exposure_jobs.operators.running import running

    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(9)}", i, rng.randrange(-50, 50), rng.randrange(1 << 40)) for i in range(600)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, i int, v long, x long").repartition(7)
    totals = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "mix": ("xor", "x")}
    found = {(r.k, r.i): (r.s, r.hi, r.lo, r.mix) for r in running(table, ["k"], ["i"], totals).collect()}
    assert len(found) == len(rows)
    state = {}
    for k, i, v, x in sorted(rows, key=lambda r: r[1]):
        s, hi, lo, mix = state.get(k, (0, v, v, 0))
        state[k] = (s + v, max(hi, v), min(lo, v), mix ^ x)
        assert found[k, i] == state[k]
    down = {r.i: r.n for r in running(table.withColumn("one", F.lit(1)), [], [F.col("i").desc()], {"n": ("sum", "one")}).collect()}
    assert down == {i: 600 - i for i in range(600)}
    assert running(table.limit(0), ["k"], ["i"], totals).count() == 0
