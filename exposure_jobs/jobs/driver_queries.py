"""The registered queries of the alert-data library and their SQL counterparts.

Instants leave as microseconds since the epoch; rates and scores are rounded to six digits on both sides. The SQL takes other routes
where there are any: range joins and next starts instead of the hour expansion, separate groupings instead of grouping sets.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure_jobs.functions.timing import micros
from exposure_jobs.jobs import fixed_queries, pooled_queries, testbed, train
from exposure_jobs.operators import baselines, extensions, features, forecast, intervals, metrics, model, panel, qc
from exposure_jobs.sources import alerts, lineage

#: Queries that score take the horizons of SCORED; each has a twin ``<name>_all`` over every horizon.
HORIZONS, SCORED, LAGS = testbed.SETTINGS.horizons, (1, 6, 24), testbed.SETTINGS.lag_hours


def _us(df: DataFrame) -> DataFrame:
    """Timestamps as ``*_us``."""
    return df.select(*(micros(c).alias(f"{c}_us") if t == "timestamp" else F.col(c) for c, t in df.dtypes))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _panel(s: SparkSession, d: str) -> DataFrame:
    return testbed.tables(s, d).origins


def _predictions(s: SparkSession, d: str, horizons: tuple, split: str = "test", names: tuple[str, ...] = baselines.NAMES) -> DataFrame:
    return baselines.train_and_predict(testbed.tables(s, d).matrix, list(horizons), split, names)


def canonical_events(s, d):
    return _us(testbed.events(s, d).drop("region_id"))


def era_counts(s, d):
    return testbed.events(s, d).groupBy("granularity_era", "admin_level").agg(F.count("*").alias("n"))


def merged_intervals(s, d):
    return _us(testbed.tables(s, d).merged)


def data_cutoffs(s, d):
    return _us(intervals.data_cutoffs(testbed.tables(s, d).merged))


def hourly_panel(s, d):
    return _us(_panel(s, d).select("region_id", "origin_hour", "active", "active_at_origin"))


def exposure_labels(s, d):
    return _us(_panel(s, d).select("region_id", "origin_hour", *(f"y_{k}" for k in HORIZONS)))


def exposure_rate(s, d, horizons=SCORED):
    rates = [(F.sum(f"y_{k}") / F.count("*")).alias(f"rate_{k}") for k in horizons]
    return _rounded(_panel(s, d).groupBy("region_id").agg(F.count("*").alias("hours"), F.sum("active").alias("active_hours"), *rates))


def feature_matrix(s, d):
    return _rounded(_us(testbed.tables(s, d).features))


def split_boundaries(s, d):
    return _us(testbed.tables(s, d).boundaries)


def split_counts(s, d):
    return _panel(s, d).groupBy("region_id", "split", "in_primary_train").agg(F.count("*").alias("n"))


def training_matrix(s, d):
    made = testbed.tables(s, d).matrix
    keep = ["region_id", "origin_hour", "active_at_origin", "active_sum_24h", "time_since_last_start_h", "hour_of_week_kyiv", "y_1", "y_6", "y_24", "split", "in_primary_train"]
    return _rounded(_us(made.select(*keep)))


def baseline_rates(s, d, horizons=SCORED):
    rates = baselines.fit_baselines(testbed.tables(s, d).matrix).filter(F.col("horizon").isin(*horizons))
    return _rounded(rates.select("region_id", "kind", "hour_of_week", "active", "horizon", "n", "hits", "rate"))


def baseline_predictions(s, d, horizons=SCORED):
    made = _predictions(s, d, horizons)
    return _rounded(_us(made.select("region_id", "origin_hour", *(c for c in made.columns if c.startswith("pred_")))))


def baseline_scores(s, d, horizons=SCORED):
    rows = baselines.long_predictions(_predictions(s, d, horizons), list(horizons))
    return _rounded(metrics.proper_scores(rows, ["region_id", "horizon", "predictor"]).drop("log_loss"))


def average_precision(s, d, horizons=SCORED):
    rows = baselines.long_predictions(_predictions(s, d, horizons), list(horizons)).withColumn("p", F.round("p", 9))
    found = metrics.average_precision(rows, ["region_id", "horizon", "predictor"])
    return found.select("region_id", "horizon", "predictor", F.round(F.nanvl("pr_auc", F.lit(-1.0)), 6).alias("pr_auc"))


def brier_uplift(s, d, horizons=SCORED):
    rows = baselines.long_predictions(_predictions(s, d, horizons), list(horizons))
    return _rounded(metrics.brier_uplift(metrics.proper_scores(rows, ["region_id", "horizon", "predictor"]), model="persistence"))


def era_scores(s, d, horizons=SCORED):
    era = F.when(F.col("origin_hour") < F.lit("2024-01-26").cast("timestamp"), "before").otherwise("after").alias("era")
    rows = baselines.long_predictions(_predictions(s, d, horizons), list(horizons)).withColumn("era", era)
    return _rounded(metrics.proper_scores(rows, ["era", "horizon", "predictor"]).drop("log_loss"))


def reliability_bins(s, d, horizons=SCORED):
    rows = baselines.long_predictions(_predictions(s, d, horizons), list(horizons)).withColumn("p", F.round("p", 6))
    made = metrics.reliability(rows, ["horizon", "predictor"])
    whole = lambda c, unit: F.round(F.col(c) * F.col("n") * unit).cast("bigint")
    return made.select("horizon", "predictor", "bin", "n", whole("mean_p", 1e6).alias("p_millionths"), whole("rate", 1).alias("hits"))


def calibration_error(s, d, horizons=SCORED):
    rows = baselines.long_predictions(_predictions(s, d, horizons), list(horizons)).withColumn("p", F.round("p", 6))
    return _rounded(metrics.calibration_error(metrics.reliability(rows, ["horizon", "predictor"]), ["horizon", "predictor"]))


def false_alarm_threshold(s, d, horizons=SCORED):
    rows = baselines.long_predictions(_predictions(s, d, horizons), list(horizons)).withColumn("p", F.round("p", 6))
    return _rounded(metrics.false_alarm_threshold(rows, ["horizon", "predictor"], 0.1))


def monotone_forecast(s, d, horizons=SCORED):
    made = _predictions(s, d, horizons, names=("seasonal",)).withColumns(forecast.monotone_columns([f"pred_seasonal_y_{k}" for k in sorted(horizons)]))
    return _rounded(_us(baselines.long_predictions(made, list(horizons), ("seasonal",)).drop("y")))


def feature_scaling(s, d):
    made = testbed.tables(s, d).matrix
    made = made.withColumns({c: F.round(c, 6) for c in ("time_since_last_start_h", "time_since_last_end_h")})
    stats = model.imputation(made, ["active_sum_24h", "time_since_last_start_h", "time_since_last_end_h"])
    return _rounded(stats, 9)


def training_matrix_all(s, d):
    return _rounded(_us(testbed.tables(s, d).matrix))


def feature_scaling_all(s, d):
    made = testbed.tables(s, d).matrix
    made = made.withColumns({c: F.round(c, 6) for c in ("time_since_last_start_h", "time_since_last_end_h")})
    stats = model.imputation(made, features.matrix_features(made.columns))
    return stats.select("region_id", "feature", F.round("median", 9).alias("median"), F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def class_weights(s, d, horizons=SCORED):
    return _rounded(model.class_weights(testbed.tables(s, d).matrix, list(horizons)))


def exposure_models(s, d):
    parameters, _ = train.train(testbed.tables(s, d).matrix.cache(), constant_single_class=True)
    each = parameters.select("region_id", "horizon", F.posexplode("features").alias("i", "feature"), "coefs", "intercept", "n_fit", "status")
    return each.select("region_id", "horizon", "feature", F.round(F.element_at("coefs", F.col("i") + 1), 6).alias("coef"), F.round("intercept", 6).alias("intercept"), "n_fit", "status")


def model_report(s, d):
    matrix = testbed.tables(s, d).matrix.cache()
    return _rounded(train.report(matrix, *train.train(matrix, constant_single_class=True)))


def forecast_latest(s, d):
    matrix = testbed.tables(s, d).matrix.cache()
    parameters, calibrators = train.train(matrix, constant_single_class=True)
    made = forecast.forecast(matrix, parameters, calibrators, testbed.regions(s, d), features.matrix_features(matrix.columns), testbed.SETTINGS.display_timezone)
    return _rounded(_us(made))


def report_table(s, d):
    matrix = testbed.tables(s, d).matrix.cache()
    return train.report_table(train.report(matrix, *train.train(matrix, constant_single_class=True)), train.report_header(matrix))


def report_header(s, d):
    return train.report_header(testbed.tables(s, d).matrix)


def forecast_listing(s, d):
    matrix = testbed.tables(s, d).matrix.cache()
    made = forecast.forecast(matrix, *train.train(matrix, constant_single_class=True), testbed.regions(s, d), features.matrix_features(matrix.columns), testbed.SETTINGS.display_timezone)
    return forecast.listing(made)


def model_stationary(s, d):
    """Is each fitted model at the optimum of its objective? The gradient there is recomputed from the rows."""
    matrix = testbed.tables(s, d).matrix.cache()
    found = model.gradients(matrix, model.fit_exposure_models(matrix, constant_single_class=True))
    return found.select("region_id", "horizon", "status", (F.col("steepest") < 1e-6).alias("stationary")).filter("status = 'fitted'")


def baseline_log_loss(s, d, horizons=SCORED):
    rows = baselines.long_predictions(_predictions(s, d, horizons), list(horizons))
    return _rounded(metrics.proper_scores(rows, ["region_id", "horizon", "predictor"]).select("region_id", "horizon", "predictor", "log_loss"))


def isotonic_midpoints(s, d, horizons=HORIZONS):
    """What isotonic calibration makes of scores between the seasonal rates of the validation rows (a quarter, the middle and three
    quarters of the way to the next one) and beyond both ends."""
    rows = baselines.long_predictions(_predictions(s, d, horizons, "validation", ("seasonal",)), list(horizons), ("seasonal",)).withColumn("p", F.round("p", 9))
    order = Window.partitionBy("region_id", "horizon").orderBy("p")
    known = rows.select("region_id", "horizon", "p").distinct().select("region_id", "horizon", F.row_number().over(order).alias("i"), F.col("p").alias("x"), F.lead("p").over(order).alias("to"))
    between = [(q, F.col("x") + (F.col("to") - F.col("x")) * (q / 4)) for q in (1, 2, 3)]
    ends = [(0, F.when(F.col("i") == 1, F.col("x") / 2)), (4, F.when(F.col("to").isNull(), (F.col("x") + 1) / 2))]
    asked = F.explode(F.array(*(F.struct(F.lit(q).alias("quarter"), p.alias("p")) for q, p in between + ends)))
    points = known.select("region_id", "horizon", "i", asked.alias("e")).select("region_id", "horizon", "i", "e.*")
    done = model.calibrated(points.filter("p IS NOT NULL"), model.fit_calibrators(rows))
    return done.select("region_id", "horizon", "i", "quarter", F.round("p", 9).alias("fitted"))


def qc_planted_durations(s, d):
    """The duration check over events of which some, by a rule on the start, have their ends swapped."""
    swapped = (F.unix_seconds("started_at") % 97 == 0) & F.col("finished_at").isNotNull()
    either = lambda a, b: F.when(swapped, F.col(a)).otherwise(F.col(b)).alias(b)
    rows = testbed.events(s, d).select("oblast", "admin_level", either("finished_at", "started_at"), either("started_at", "finished_at"))
    return _us(qc.negative_durations(rows))


def qc_planted_labels(s, d, horizons=SCORED):
    """The label check over a panel in which every fiftieth hour has the other label."""
    t = testbed.tables(s, d)
    wrong = F.floor(F.unix_seconds("origin_hour") / 3600) % 50 == 0
    origins = t.origins.withColumns({f"y_{k}": F.when(wrong, 1 - F.col(f"y_{k}")).otherwise(F.col(f"y_{k}")) for k in horizons})
    return _us(qc.label_mismatches(origins, t.merged, list(horizons)).select("region_id", "origin_hour", "horizon", "y", "want"))


def isotonic_seasonal(s, d, horizons=SCORED):
    """The seasonal rates of the validation rows and what isotonic calibration makes of them."""
    rows = baselines.long_predictions(_predictions(s, d, horizons, "validation", ("seasonal",)), list(horizons), ("seasonal",)).withColumn("p", F.round("p", 9))
    points = rows.select("region_id", "horizon", "p").distinct().withColumn("x", F.col("p"))
    done = model.calibrated(points, model.fit_calibrators(rows))
    return done.select("region_id", "horizon", F.round("x", 9).alias("x"), F.round("p", 9).alias("fitted"))


def manifest(s, d):
    t = testbed.tables(s, d)
    made = alerts.manifest(t.merged, t.origins, t.boundaries, "events")
    return _us(made.select("region_id", "interval_count", "origin_count", "active_origin_count", "range_start", "range_end", "test_end", "source"))


def raw_lineage(s, d):
    """The raw feed's row count and order-free digest, with the run's windows, labels and features."""
    matrix = testbed.tables(s, d).matrix
    return lineage.run_facts(lineage.row_digest(testbed.raw_alerts(s, d)), panel.label_columns(matrix.columns), features.matrix_features(matrix.columns), testbed.SETTINGS.validation_weeks, testbed.SETTINGS.test_weeks)


def qc_raw_drift(s, d):
    raw = testbed.raw_alerts(s, d)
    return qc.validate_raw(raw, alerts.RAW_COLUMNS, 1)


def qc_negative_durations(s, d):
    return _us(qc.negative_durations(testbed.events(s, d)).select("alert_id", "started_at", "finished_at"))


def qc_overlaps(s, d):
    closed = intervals.close_open(testbed.events(s, d), testbed.DATA_CUTOFF)
    return qc.overlapping_intervals(closed.select("region_id", "started_at", "finished_at")).groupBy("region_id").agg(F.count("*").alias("n"))


def qc_label_mismatches(s, d):
    t = testbed.tables(s, d)
    return _us(qc.label_mismatches(t.origins, t.merged, list(HORIZONS)).select("region_id", "origin_hour", "horizon", "y", "want"))


def x_deduped(s, d):
    twice = testbed.events(s, d).unionByName(testbed.events(s, d).filter("admin_level = 'raion'"))
    return extensions.dedupe_events(twice).groupBy("region_id").agg(F.count("*").alias("n"))


def x_sub_units(s, d):
    from exposure_jobs.sources.regions import sub_unit

    rows = testbed.events(s, d).withColumn("region_id", sub_unit(F.col("oblast"), F.col("raion")))
    return _us(intervals.merged_intervals(rows, testbed.DATA_CUTOFF).drop("is_outlier_duration"))


def x_minutes(s, d):
    return _rounded(_us(extensions.minutes_under_alert(testbed.tables(s, d).merged)))


def x_type_union(s, d, horizons=SCORED):
    names = ("seasonal", "persistence")
    of = [F.array(*(f"pred_{b}_y_{k}" for k in horizons)).alias(b) for b in names]
    each = _predictions(s, d, horizons, names=names).select("region_id", "origin_hour", *of).select("*", F.posexplode(F.array(*map(F.lit, horizons))).alias("at", "horizon"))
    either = extensions.type_union_of([F.round(F.get(b, "at"), 6) for b in names])
    return _rounded(_us(each.select("region_id", "origin_hour", "horizon", either.alias("p"))), 12)


def _typed(s, d):
    return intervals.close_open(testbed.events(s, d), testbed.DATA_CUTOFF).withColumn("kind", F.col("admin_level"))


def x_activity_by_type(s, d):
    return extensions.activity_by_type(_typed(s, d)).groupBy("region_id", "kind").agg(F.count("*").alias("active_hours"))


def x_overlapping_types(s, d):
    return _us(extensions.overlapping_types(testbed.tables(s, d).merged, _typed(s, d)))


def x_older_weight(s, d):
    matrix = testbed.tables(s, d).matrix
    made = model.fit_exposure_models(matrix, older_weight=0.25, constant_single_class=True)
    return made.select("region_id", "horizon", F.round("intercept", 6).alias("intercept"), "n_fit")


def x_sufficiency(s, d):
    t = testbed.tables(s, d)
    made = extensions.sufficiency(t.merged, t.origins)
    return _rounded(made.select("region_id", "hours", "intervals", "active_rate", "rate_y_1", "rate_y_24"))


def x_durations(s, d):
    return extensions.duration_statistics(testbed.events(s, d))


_RAW = """
raw AS (SELECT 'r' || user_id AS region_id, CASE WHEN event_id % 3 >= 1 THEN event_type ELSE '' END AS raion, CASE WHEN event_id % 3 = 2 THEN event_type ELSE '' END AS hromada,
        CASE event_id % 3 WHEN 0 THEN 'oblast' WHEN 1 THEN 'raion' ELSE 'hromada' END AS level, date_trunc('second', ts) AS s,
        CASE WHEN event_id % 1009 = 0 THEN NULL ELSE date_trunc('second', ts) + to_seconds(floor(value * 60)::BIGINT) END AS e0 FROM events),
closed AS (SELECT *, coalesce(e0, TIMESTAMP '2024-02-01 00:00:00') AS e FROM raw)"""


def _islands(source: str, name: str) -> str:
    return f"""
{name}_o AS (SELECT region_id, s, e, max(e) OVER (PARTITION BY region_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {source}),
{name}_k AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY region_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM {name}_o),
{name} AS (SELECT region_id, min(s) AS s, max(e) AS e FROM {name}_k GROUP BY region_id, k)"""


_MERGED = f"{_RAW},{_islands('closed', 'merged')},\ncut AS (SELECT region_id, min(s) AS s0, max(e) AS c FROM merged GROUP BY region_id)"
_GRID = f"""{_MERGED},
grid AS (SELECT region_id, unnest(generate_series(date_trunc('hour', s0), date_trunc('hour', c), INTERVAL 1 HOUR)) AS t FROM cut),
nx AS (SELECT g.region_id, g.t, min(m.s) AS nx FROM grid g LEFT JOIN merged m ON m.region_id = g.region_id AND m.e > g.t GROUP BY g.region_id, g.t),
lasts AS (SELECT g.region_id, g.t, max(m.s) AS ls, max(CASE WHEN m.e <= g.t THEN m.e END) AS le FROM grid g LEFT JOIN merged m ON m.region_id = g.region_id AND m.s <= g.t GROUP BY g.region_id, g.t),
panel AS (SELECT nx.region_id, nx.t, coalesce(nx.nx < nx.t + INTERVAL 1 HOUR, false)::INTEGER AS active, coalesce(nx.nx <= nx.t, false)::INTEGER AS active_at_origin,
          {', '.join(f"coalesce(nx.nx <= nx.t + INTERVAL {k} HOUR, false)::INTEGER AS y_{k}" for k in HORIZONS)} FROM nx)"""
_SPLIT = f"""{_GRID},
b AS (SELECT region_id, c - INTERVAL 14 DAY AS vs, c - INTERVAL 7 DAY AS tst, c FROM cut),
origins AS (SELECT p.*, CASE WHEN t > tst AND t <= c THEN 'test' WHEN t > vs AND t <= tst THEN 'validation' WHEN t <= vs THEN 'train' ELSE 'holdout' END AS split,
            t >= vs - INTERVAL 10 DAY AND t <= vs AS in_primary_train FROM panel p JOIN b ON p.region_id = b.region_id)"""
_FEATURES = f"""{_SPLIT},
local AS (SELECT region_id, t, timezone('Europe/Kyiv', timezone('UTC', t)) AS l FROM grid),
feats AS (SELECT p.region_id, p.t, p.active_at_origin,
          {', '.join(f"coalesce(sum(p.active) OVER (PARTITION BY p.region_id ORDER BY p.t ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), 0)::INTEGER AS active_sum_{k}h" for k in LAGS)},
          round(floor((epoch_us(p.t) - epoch_us(ls)) / 1000000) / 3600, 6) AS time_since_last_start_h, round(floor((epoch_us(p.t) - epoch_us(le)) / 1000000) / 3600, 6) AS time_since_last_end_h,
          extract(hour FROM l)::INTEGER AS hour_kyiv, (extract(isodow FROM l) - 1)::INTEGER AS dow_kyiv, ((extract(isodow FROM l) - 1) * 24 + extract(hour FROM l))::INTEGER AS hour_of_week_kyiv
          FROM panel p JOIN lasts ON p.region_id = lasts.region_id AND p.t = lasts.t JOIN local ON p.region_id = local.region_id AND p.t = local.t),
matrix AS (SELECT f.*, o.split, o.in_primary_train, {', '.join(f'o.y_{k}' for k in HORIZONS)} FROM feats f JOIN origins o ON f.region_id = o.region_id AND f.t = o.t)"""


def _rates(horizons: tuple) -> str:
    long = " UNION ALL ".join(f"SELECT region_id, hour_of_week_kyiv AS how, active_at_origin AS act, {k} AS horizon, y_{k} AS y FROM matrix WHERE split = 'train'" for k in horizons)
    return f"""{_FEATURES},
lt AS ({long}),
rm AS (SELECT region_id, horizon, count(*) AS n, sum(y) AS hits FROM lt GROUP BY ALL),
rs AS (SELECT region_id, how, horizon, count(*) AS n, sum(y) AS hits FROM lt GROUP BY ALL),
rp AS (SELECT region_id, act, horizon, count(*) AS n, sum(y) AS hits FROM lt GROUP BY ALL)"""


def _pred(horizons: tuple) -> str:
    long = " UNION ALL ".join(f"SELECT region_id, t, hour_of_week_kyiv AS how, active_at_origin AS act, {k} AS horizon, y_{k} AS y FROM matrix WHERE split = 'test'" for k in horizons)
    return f"""{_rates(horizons)},
te AS ({long}),
pw AS (SELECT te.region_id, te.t, te.horizon, te.y, rm.hits::DOUBLE / rm.n AS marginal, coalesce(rs.hits::DOUBLE / rs.n, rm.hits::DOUBLE / rm.n) AS seasonal, coalesce(rp.hits::DOUBLE / rp.n, rm.hits::DOUBLE / rm.n) AS persistence
       FROM te LEFT JOIN rm ON te.region_id = rm.region_id AND te.horizon = rm.horizon LEFT JOIN rs ON te.region_id = rs.region_id AND te.horizon = rs.horizon AND te.how = rs.how
       LEFT JOIN rp ON te.region_id = rp.region_id AND te.horizon = rp.horizon AND te.act = rp.act),
lp AS ({" UNION ALL ".join(f"SELECT region_id, t, horizon, y, '{b}' AS predictor, {b} AS p FROM pw" for b in baselines.NAMES)}),
l6 AS (SELECT region_id, t, horizon, y, predictor, round(p, 6) AS p FROM lp)"""



def _isotonic(horizons: tuple) -> str:
    validation = " UNION ALL ".join(f"SELECT region_id, hour_of_week_kyiv AS how, {k} AS horizon, y_{k} AS y FROM matrix WHERE split = 'validation'" for k in horizons)
    return f"""WITH {_rates(horizons)}, va AS ({validation}),
        q AS (SELECT va.region_id, va.horizon, va.y, round(coalesce(rs.hits::DOUBLE / rs.n, rm.hits::DOUBLE / rm.n), 9) AS x FROM va JOIN rm ON va.region_id = rm.region_id AND va.horizon = rm.horizon
              LEFT JOIN rs ON va.region_id = rs.region_id AND va.horizon = rs.horizon AND va.how = rs.how),
        pt AS (SELECT region_id, horizon, x, count(*) AS n, sum(y) AS s FROM q GROUP BY ALL),
        pr AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(s) OVER v AS ts, sum(n) OVER v AS tn FROM pt
               WINDOW w AS (PARTITION BY region_id, horizon ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY region_id, horizon)),
        mm AS (SELECT a.region_id, a.horizon, a.i AS j, i.i AS i, min((k.cs - a.cs + a.s)::DOUBLE / (k.cn - a.cn + a.n)::DOUBLE) AS lo FROM pr a
               JOIN pr i ON a.region_id = i.region_id AND a.horizon = i.horizon AND a.i <= i.i JOIN pr k ON a.region_id = k.region_id AND a.horizon = k.horizon AND k.i >= i.i GROUP BY ALL),
        ft AS (SELECT region_id, horizon, i, max(lo) AS f FROM mm GROUP BY ALL)"""


def _typed_sql(name: str) -> str:
    return f"{name} AS (SELECT region_id, level AS kind, s, e FROM closed)"


def _oracle_sql(horizons: tuple) -> dict[str, str]:
    """The SQL of every query; those that score horizons take the given ones."""
    rates, pred = _rates(horizons), _pred(horizons)
    scores = f"{pred},\nsc AS (SELECT region_id, horizon, predictor, count(*)::BIGINT AS n_samples, avg(y) AS positive_rate, avg((p - y) * (p - y)) AS brier_score FROM lp GROUP BY ALL)"
    return {
        "canonical_events": f"""WITH {_RAW} SELECT substr(sha256(region_id || '|' || raion || '|' || hromada || '|' || level || '|' || strftime(s, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || coalesce(strftime(e0, '%Y-%m-%dT%H:%M:%S') || '+00:00', '')), 1, 16) AS alert_id,
            region_id AS oblast, raion, hromada, level AS admin_level, epoch_us(s) AS started_at_us, epoch_us(e0) AS finished_at_us,
            CASE WHEN s < TIMESTAMP '2024-01-15' AND level = 'oblast' THEN 'oblast_dominant' WHEN s >= TIMESTAMP '2024-01-15' AND level <> 'oblast' THEN 'raion_dominant' ELSE 'mixed' END AS granularity_era,
            coalesce(e0 - s > INTERVAL 7 DAY, false) AS is_outlier_duration, 'official' AS source FROM raw""",
        "era_counts": f"""WITH {_RAW} SELECT CASE WHEN s < TIMESTAMP '2024-01-15' AND level = 'oblast' THEN 'oblast_dominant' WHEN s >= TIMESTAMP '2024-01-15' AND level <> 'oblast' THEN 'raion_dominant' ELSE 'mixed' END AS granularity_era, level AS admin_level, count(*)::BIGINT AS n FROM raw GROUP BY ALL""",
        "merged_intervals": f"WITH {_MERGED} SELECT region_id, epoch_us(s) AS started_at_us, epoch_us(e) AS finished_at_us, epoch_us(e) - epoch_us(s) > 604800000000 AS is_outlier_duration FROM merged",
        "data_cutoffs": f"WITH {_MERGED} SELECT region_id, epoch_us(s0) AS first_start_us, epoch_us(c) AS data_cutoff_us FROM cut",
        "hourly_panel": f"WITH {_GRID} SELECT region_id, epoch_us(t) AS origin_hour_us, active, active_at_origin FROM panel",
        "exposure_labels": f"WITH {_GRID} SELECT region_id, epoch_us(t) AS origin_hour_us, {', '.join(f'y_{k}' for k in HORIZONS)} FROM panel",
        "exposure_rate": f"WITH {_GRID} SELECT region_id, count(*)::BIGINT AS hours, sum(active)::BIGINT AS active_hours, {', '.join(f'round(sum(y_{k})::DOUBLE / count(*), 6) AS rate_{k}' for k in horizons)} FROM panel GROUP BY region_id",
        "feature_matrix": f"WITH {_FEATURES} SELECT region_id, epoch_us(t) AS origin_hour_us, {', '.join(features.feature_columns(LAGS))} FROM feats",
        "split_boundaries": f"WITH {_SPLIT} SELECT region_id, epoch_us(vs) AS train_end_us, epoch_us(vs) AS val_start_us, epoch_us(tst) AS val_end_us, epoch_us(tst) AS test_start_us, epoch_us(c) AS test_end_us FROM b",
        "split_counts": f"WITH {_SPLIT} SELECT region_id, split, in_primary_train, count(*)::BIGINT AS n FROM origins GROUP BY ALL",
        "training_matrix": f"WITH {_FEATURES} SELECT region_id, epoch_us(t) AS origin_hour_us, active_at_origin, active_sum_24h, time_since_last_start_h, hour_of_week_kyiv, y_1, y_6, y_24, split, in_primary_train FROM matrix",
        "baseline_rates": f"""WITH {rates} SELECT region_id, kind, hour_of_week, active, horizon, n::BIGINT AS n, hits::BIGINT AS hits, round(hits::DOUBLE / n, 6) AS rate FROM (
            SELECT region_id, 'marginal' AS kind, NULL::INTEGER AS hour_of_week, NULL::INTEGER AS active, horizon, n, hits FROM rm UNION ALL SELECT region_id, 'seasonal', how, NULL, horizon, n, hits FROM rs UNION ALL SELECT region_id, 'persistence', NULL, act, horizon, n, hits FROM rp)""",
        "baseline_predictions": f"WITH {pred} SELECT region_id, epoch_us(t) AS origin_hour_us, {', '.join(f'round(max(CASE WHEN horizon = {k} THEN {b} END), 6) AS pred_{b}_y_{k}' for b in baselines.NAMES for k in horizons)} FROM pw GROUP BY region_id, t",
        "baseline_scores": f"WITH {scores} SELECT region_id, horizon, predictor, n_samples, round(positive_rate, 6) AS positive_rate, round(brier_score, 6) AS brier_score FROM sc",
        "average_precision": f"""WITH {pred}, r9 AS (SELECT region_id, horizon, predictor, y, round(p, 9) AS p FROM lp),
            tied AS (SELECT region_id, horizon, predictor, p, count(*) AS n, sum(y) AS hits FROM r9 GROUP BY ALL),
            ran AS (SELECT *, sum(n) OVER w AS seen, sum(hits) OVER w AS found FROM tied WINDOW w AS (PARTITION BY region_id, horizon, predictor ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            SELECT region_id, horizon, predictor, CASE WHEN sum(hits) > 0 AND sum(hits) < sum(n) THEN round(sum(hits::DOUBLE * found::DOUBLE / seen::DOUBLE) / sum(hits)::DOUBLE, 6) ELSE -1.0::DOUBLE END AS pr_auc FROM ran GROUP BY ALL""",
        "brier_uplift": f"WITH {scores} SELECT a.region_id, a.horizon, a.predictor, round(a.brier_score - m.brier_score, 6) AS brier_uplift FROM sc a JOIN sc m ON a.region_id = m.region_id AND a.horizon = m.horizon AND m.predictor = 'persistence' WHERE a.predictor <> 'persistence'",
        "era_scores": f"WITH {pred} SELECT CASE WHEN t < TIMESTAMP '2024-01-26' THEN 'before' ELSE 'after' END AS era, horizon, predictor, count(*)::BIGINT AS n_samples, round(avg(y), 6) AS positive_rate, round(avg((p - y) * (p - y)), 6) AS brier_score FROM lp GROUP BY ALL",
        "reliability_bins": f"WITH {pred} SELECT horizon, predictor, least(floor(p * 10), 9)::INTEGER AS bin, count(*)::BIGINT AS n, sum(round(p * 1000000)::BIGINT)::BIGINT AS p_millionths, sum(y)::BIGINT AS hits FROM l6 GROUP BY ALL",
        "calibration_error": f"WITH {pred}, bins AS (SELECT horizon, predictor, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM l6 GROUP BY ALL) SELECT horizon, predictor, round(sum(abs(mp - rate) * n) / sum(n), 6) AS ece FROM bins GROUP BY ALL",
        "false_alarm_threshold": f"""WITH {pred}, tied AS (SELECT horizon, predictor, p, sum(1 - y) AS neg, sum(y) AS pos FROM l6 GROUP BY ALL),
            ran AS (SELECT *, sum(neg) OVER w AS fa, sum(pos) OVER w AS hit, sum(neg) OVER v AS negs, sum(pos) OVER v AS poss FROM tied WINDOW w AS (PARTITION BY horizon, predictor ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY horizon, predictor))
            SELECT horizon, predictor, round(min(CASE WHEN fa <= 0.1 * negs THEN p END), 6) AS threshold, round(max(CASE WHEN fa <= 0.1 * negs AND poss > 0 THEN hit::DOUBLE / poss::DOUBLE END), 6) AS recall FROM ran GROUP BY ALL""",
        "monotone_forecast": f"WITH {pred} SELECT region_id, epoch_us(t) AS origin_hour_us, horizon, predictor, round(max(p) OVER (PARTITION BY region_id, t ORDER BY horizon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS p FROM lp WHERE predictor = 'seasonal'",
        "feature_scaling": f"""WITH {_FEATURES}, f AS (SELECT region_id, unnest(['active_sum_24h', 'time_since_last_start_h', 'time_since_last_end_h']) AS feature,
            unnest([active_sum_24h::DOUBLE, time_since_last_start_h, time_since_last_end_h]) AS v FROM matrix WHERE in_primary_train),
            m AS (SELECT region_id, feature, median(v) AS median FROM f GROUP BY ALL)
            SELECT f.region_id, f.feature, round(any_value(m.median), 9) AS median, round(avg(coalesce(v, m.median, 0)), 9) AS mean, round(stddev_pop(coalesce(v, m.median, 0)), 9) AS deviation FROM f JOIN m ON f.region_id = m.region_id AND f.feature = m.feature GROUP BY f.region_id, f.feature""",
        "class_weights": f"""WITH {_FEATURES}, l AS ({" UNION ALL ".join(f"SELECT region_id, {k} AS horizon, y_{k} AS y FROM matrix WHERE in_primary_train" for k in horizons)}), c AS (SELECT region_id, horizon, count(*) AS n, sum(y) AS p FROM l GROUP BY ALL)
            SELECT region_id, horizon, n::BIGINT AS n, round(n::DOUBLE / nullif(2 * (n - p), 0)::DOUBLE, 6) AS weight_0, round(n::DOUBLE / nullif(2 * p, 0)::DOUBLE, 6) AS weight_1 FROM c""",
        "isotonic_seasonal": f"""{_isotonic(horizons)}
            SELECT pr.region_id, pr.horizon, round(pr.x, 9) AS x, round(CASE WHEN ts = 0 OR ts = tn THEN pr.x ELSE f END, 9) AS fitted FROM pr JOIN ft ON pr.region_id = ft.region_id AND pr.horizon = ft.horizon AND pr.i = ft.i""",
        "isotonic_midpoints": f"""{_isotonic(HORIZONS)},
            nb AS (SELECT pr.region_id, pr.horizon, pr.i, pr.x, ts = 0 OR ts = tn AS alike, f FROM pr JOIN ft ON pr.region_id = ft.region_id AND pr.horizon = ft.horizon AND pr.i = ft.i),
            nb2 AS (SELECT *, lead(x) OVER w AS x1, lead(f) OVER w AS f1 FROM nb WINDOW w AS (PARTITION BY region_id, horizon ORDER BY i)),
            ask AS (SELECT nb2.*, quarter, CASE WHEN quarter = 0 THEN CASE WHEN i = 1 THEN x / 2 END WHEN quarter = 4 THEN CASE WHEN x1 IS NULL THEN (x + 1) / 2 END ELSE x + (x1 - x) * (quarter / 4.0::DOUBLE) END AS p
                    FROM nb2 CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS quarter))
            SELECT region_id, horizon, i::INTEGER AS i, quarter, round(CASE WHEN alike THEN p WHEN quarter IN (0, 4) THEN f ELSE f + (f1 - f) * (p - x) / (x1 - x) END, 9) AS fitted FROM ask WHERE p IS NOT NULL""",
        "report_header": f"""WITH {_FEATURES} SELECT region_id, count(*) FILTER (in_primary_train)::BIGINT AS train_rows, count(*) FILTER (split = 'validation')::BIGINT AS validation_rows,
            count(*) FILTER (split = 'test')::BIGINT AS test_rows, {len(features.feature_columns(LAGS))} AS feature_count, 'isotonic' AS calibration_method FROM matrix GROUP BY region_id""",
        "model_stationary": f"""WITH {_FEATURES}, l AS ({" UNION ALL ".join(f"SELECT region_id, {k} AS horizon, y_{k} AS y FROM matrix WHERE in_primary_train" for k in HORIZONS)})
            SELECT region_id, horizon, 'fitted' AS status, true AS stationary FROM l GROUP BY region_id, horizon HAVING min(y) < max(y)""",
        "baseline_log_loss": f"""WITH {pred}, q AS (SELECT *, least(greatest(p, {metrics.EPSILON!r}::DOUBLE), 1 - {metrics.EPSILON!r}::DOUBLE) AS q FROM lp)
            SELECT region_id, horizon, predictor, round(avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)), 6) AS log_loss FROM q GROUP BY ALL""",
        "qc_planted_durations": f"""WITH {_RAW}, w AS (SELECT *, epoch_us(s) // 1000000 % 97 = 0 AND e0 IS NOT NULL AS swapped FROM raw),
            x AS (SELECT region_id AS oblast, level AS admin_level, CASE WHEN swapped THEN e0 ELSE s END AS a, CASE WHEN swapped THEN s ELSE e0 END AS b FROM w)
            SELECT oblast, admin_level, epoch_us(a) AS started_at_us, epoch_us(b) AS finished_at_us FROM x WHERE b < a""",
        "qc_planted_labels": f"WITH {_GRID} " + " UNION ALL ".join(f"SELECT region_id, epoch_us(t) AS origin_hour_us, {k} AS horizon, 1 - y_{k} AS y, y_{k} AS want FROM panel WHERE epoch_us(t) // 3600000000 % 50 = 0" for k in horizons),
        "manifest": f"""WITH {_GRID}, i AS (SELECT region_id, count(*) AS n FROM merged GROUP BY region_id)
            SELECT p.region_id, any_value(i.n)::BIGINT AS interval_count, count(*)::BIGINT AS origin_count, sum(active)::BIGINT AS active_origin_count, epoch_us(min(t)) AS range_start_us, epoch_us(max(t)) AS range_end_us, epoch_us(any_value(c)) AS test_end_us, 'events' AS source
            FROM panel p JOIN i ON p.region_id = i.region_id JOIN cut ON p.region_id = cut.region_id GROUP BY p.region_id""",
        "qc_raw_drift": "SELECT 'row_count' AS \"check\", 'expected 1, found ' || count(*) AS detail FROM events",
        "qc_negative_durations": f"WITH {_RAW} SELECT '' AS alert_id, epoch_us(s) AS started_at_us, epoch_us(e0) AS finished_at_us FROM raw WHERE e0 < s",
        "qc_overlaps": f"WITH {_RAW}, l AS (SELECT region_id, s, e, lag(e) OVER (PARTITION BY region_id ORDER BY s, e) AS pe FROM closed) SELECT region_id, count(*)::BIGINT AS n FROM l WHERE e < s OR s <= pe GROUP BY region_id",
        "qc_label_mismatches": "SELECT '' AS region_id, 0::BIGINT AS origin_hour_us, 0::INTEGER AS horizon, 0::INTEGER AS y, 0::INTEGER AS want WHERE false",
        "x_deduped": f"WITH {_RAW} SELECT region_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT region_id, raion, hromada, level, s, e0 FROM raw) GROUP BY region_id",
        "x_sub_units": f"WITH {_RAW}, sub AS (SELECT CASE WHEN raion = '' THEN region_id ELSE region_id || '/' || raion END AS region_id, s, e FROM closed),{_islands('sub', 'm2')} SELECT region_id, epoch_us(s) AS started_at_us, epoch_us(e) AS finished_at_us FROM m2",
        "x_minutes": f"WITH {_GRID} SELECT g.region_id, epoch_us(g.t) AS origin_hour_us, round(sum(epoch_us(least(m.e, g.t + INTERVAL 1 HOUR)) - epoch_us(greatest(m.s, g.t)))::DOUBLE / 60000000, 6) AS minutes FROM grid g JOIN merged m ON g.region_id = m.region_id AND m.s < g.t + INTERVAL 1 HOUR AND m.e > g.t GROUP BY g.region_id, g.t HAVING sum(epoch_us(least(m.e, g.t + INTERVAL 1 HOUR)) - epoch_us(greatest(m.s, g.t))) > 0",
        "x_type_union": f"WITH {pred} SELECT region_id, epoch_us(t) AS origin_hour_us, horizon, round(1 - (1 - round(max(seasonal), 6)) * (1 - round(max(persistence), 6)), 12) AS p FROM pw GROUP BY ALL",
        "x_activity_by_type": f"WITH {_GRID}, {_typed_sql('ty')} SELECT region_id, kind, count(*)::BIGINT AS active_hours FROM (SELECT DISTINCT g.region_id, g.t, ty.kind FROM grid g JOIN ty ON g.region_id = ty.region_id AND ty.s < g.t + INTERVAL 1 HOUR AND ty.e > g.t) GROUP BY region_id, kind",
        "x_overlapping_types": f"WITH {_MERGED}, {_typed_sql('ty')} SELECT DISTINCT m.region_id, epoch_us(m.s) AS started_at_us, ty.kind FROM merged m JOIN ty ON m.region_id = ty.region_id AND ty.s < m.e AND ty.e > m.s",
        "x_sufficiency": f"WITH {_GRID}, i AS (SELECT region_id, count(*)::BIGINT AS n FROM merged GROUP BY region_id) SELECT p.region_id, count(*)::BIGINT AS hours, any_value(i.n) AS intervals, round(avg(active), 6) AS active_rate, round(avg(y_1), 6) AS rate_y_1, round(avg(y_24), 6) AS rate_y_24 FROM panel p JOIN i ON p.region_id = i.region_id GROUP BY p.region_id",
        "x_durations": f"WITH {_RAW} SELECT region_id, count(*)::BIGINT AS n, count(*) FILTER (e0 = s)::BIGINT AS zero, count(*) FILTER (e0 > s AND e0 < s + INTERVAL 1 MINUTE)::BIGINT AS sub_minute, count(*) FILTER (e0 - s > INTERVAL 7 DAY)::BIGINT AS outlier, count(*) FILTER (e0 IS NULL)::BIGINT AS censored FROM raw GROUP BY region_id",
    }


QUERIES = {
    f.__name__: f
    for f in (
        canonical_events, era_counts, merged_intervals, data_cutoffs, hourly_panel, exposure_labels, exposure_rate, feature_matrix, split_boundaries, split_counts, training_matrix,
        baseline_rates, baseline_predictions, baseline_scores, average_precision, brier_uplift, era_scores, reliability_bins, calibration_error, false_alarm_threshold, monotone_forecast,
        feature_scaling, class_weights, isotonic_seasonal, exposure_models, model_report, forecast_latest, manifest, qc_raw_drift, qc_negative_durations, qc_overlaps, qc_label_mismatches,
        x_deduped, x_sub_units, x_minutes, x_type_union, x_activity_by_type, x_overlapping_types, x_older_weight, x_sufficiency, x_durations,
        report_table, report_header, forecast_listing, model_stationary, baseline_log_loss, isotonic_midpoints, qc_planted_durations, qc_planted_labels,
    )
}

_SCORED_QUERIES = (
    exposure_rate, baseline_rates, baseline_predictions, baseline_scores, average_precision, brier_uplift, era_scores, reliability_bins, calibration_error, false_alarm_threshold,
    monotone_forecast, class_weights, isotonic_seasonal, x_type_union,
)
QUERIES |= {f.__name__: f for f in (training_matrix_all, feature_scaling_all, raw_lineage)}
QUERIES |= {f"{f.__name__}_all": partial(f, horizons=HORIZONS) for f in _SCORED_QUERIES}

_NAMES = features.feature_columns(LAGS)
ORACLE_SQL = _oracle_sql(SCORED)
ORACLE_SQL |= {f"{f.__name__}_all": _oracle_sql(HORIZONS)[f.__name__] for f in _SCORED_QUERIES}
_FIELDS = ["region_id", "CASE WHEN event_id % 3 >= 1 THEN event_type END", "CASE WHEN event_id % 3 = 2 THEN event_type ELSE '' END", "level", "strftime(s, '%Y-%m-%d %H:%M:%S') || '+00:00'", "coalesce(strftime(e0, '%Y-%m-%d %H:%M:%S') || '+00:00', '')", "'official'"]
ORACLE_SQL |= {
    "raw_lineage": f"""WITH x AS (SELECT *, 'r' || user_id AS region_id, CASE event_id % 3 WHEN 0 THEN 'oblast' WHEN 1 THEN 'raion' ELSE 'hromada' END AS level, date_trunc('second', ts) AS s,
        CASE WHEN event_id % 1009 = 0 THEN NULL ELSE date_trunc('second', ts) + to_seconds(floor(value * 60)::BIGINT) END AS e0 FROM events),
        y AS (SELECT {' || '.join(f"coalesce(octet_length(encode({f})) || ':' || {f} || ';', '-;')" for f in _FIELDS)} AS r FROM x)
        SELECT count(*)::BIGINT AS raw_rows, coalesce(sum(('0x' || substr(sha256(r), 1, 15))::BIGINT), 0)::VARCHAR AS raw_digest, 1 AS validation_weeks, 1 AS test_weeks,
        '{",".join(f"y_{k}" for k in HORIZONS)}' AS labels, '{",".join(_NAMES)}' AS features FROM y""",
    "training_matrix_all": f"WITH {_FEATURES} SELECT * EXCLUDE (t), epoch_us(t) AS origin_hour_us FROM matrix",
    "feature_scaling_all": f"""WITH {_FEATURES}, f AS (SELECT region_id, unnest([{', '.join(map(repr, _NAMES))}]) AS feature, unnest([{', '.join(f'{n}::DOUBLE' for n in _NAMES)}]) AS v FROM matrix WHERE in_primary_train),
        m AS (SELECT region_id, feature, median(v) AS median FROM f GROUP BY ALL)
        SELECT f.region_id, f.feature, round(any_value(m.median), 9) AS median, round(avg(coalesce(v, m.median, 0)), 6) AS mean, round(stddev_pop(coalesce(v, m.median, 0)), 6) AS deviation FROM f JOIN m ON f.region_id = m.region_id AND f.feature = m.feature GROUP BY f.region_id, f.feature""",
}
QUERIES |= pooled_queries.QUERIES
ORACLE_SQL |= pooled_queries.oracle_sql(_pred(HORIZONS), _rates(HORIZONS), _FEATURES)
QUERIES |= fixed_queries.QUERIES
ORACLE_SQL |= fixed_queries.oracle_sql(_pred(HORIZONS), _FEATURES)
