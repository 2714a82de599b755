"""Registered queries that predict, calibrate, report and forecast by parameters from a rule, so that SQL can say the same without a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure_jobs.functions.timing import micros
from exposure_jobs.jobs import testbed, train
from exposure_jobs.operators import features, forecast, metrics, model

HORIZONS = testbed.SETTINGS.horizons
NAMES = features.feature_columns(testbed.SETTINGS.lag_hours)
#: By the horizon's remainder by three: knots, a slope and an intercept, nothing.
KNOTS_X, KNOTS_Y, SIGMOID = [0.125, 0.3, 0.625, 0.9], [0.05, 0.2, 0.55, 0.95], (3.5, -1.75)
HOURS = ["time_since_last_start_h", "time_since_last_end_h"]


def rule(horizon: int) -> dict:
    """Medians, means, scales, coefficients and intercept of a horizon's model, by feature number."""
    n = range(len(NAMES))
    return {
        "medians": [1.0 + i for i in n],
        "means": [0.5 * (i + 1) for i in n],
        "scales": [1.0 + 0.75 * i * i for i in n],
        "coefs": [((7 * i + horizon) % 11 - 5) / 10 for i in n],
        "intercept": (horizon % 5 - 2) / 4 + horizon / 24,
    }


def parameters(regions: DataFrame) -> DataFrame:
    rows = [(k, NAMES, *(rule(k)[c] for c in ("medians", "means", "scales", "coefs", "intercept")), 1, "fitted") for k in HORIZONS]
    made = regions.sparkSession.createDataFrame(rows, model.PARAMETERS.removeprefix("region_id string, "))
    return regions.select("region_id").crossJoin(F.broadcast(made))  # a row for each of 24 horizons


def calibrators(regions: DataFrame) -> DataFrame:
    of = lambda k: [("isotonic", KNOTS_X, KNOTS_Y), ("sigmoid", [SIGMOID[0]], [SIGMOID[1]]), ("identity", [], [])][k % 3]
    made = regions.sparkSession.createDataFrame([(k, *of(k)) for k in HORIZONS], model.CALIBRATION.removeprefix("region_id string, "))
    return regions.select("region_id").crossJoin(F.broadcast(made))


def _given(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    matrix = testbed.tables(s, d).matrix.withColumns({c: F.round(c, 6) for c in HOURS})
    regions = testbed.regions(s, d)
    return matrix, parameters(regions), calibrators(regions), regions


def fixed_predictions(s, d):
    """Raw and calibrated probabilities of all test rows."""
    matrix, given, bent, _ = _given(s, d)
    raw = model.predict_raw(matrix.filter("split = 'test'"), given, NAMES).withColumn("raw", F.col("p"))
    made = model.calibrated(raw, bent)
    return made.select("region_id", micros("origin_hour").alias("origin_hour_us"), "horizon", F.round("raw", 9).alias("raw"), F.round("p", 9).alias("p"))


def fixed_report(s, d):
    """Model and baselines on the test rows: all metrics and the uplift."""
    rest = [F.round(c, 6).alias(c) for c in ("positive_rate", "brier_score", "log_loss", "model_uplift")]
    matrix, given, bent, _ = _given(s, d)
    made = train.report(matrix, given, bent)
    return made.select("region_id", "horizon", "predictor", "n_samples", *rest, F.round(F.nanvl("pr_auc", F.lit(-1.0)), 6).alias("pr_auc"))


def _forecast(s, d, at: str = "latest") -> DataFrame:
    matrix, given, bent, regions = _given(s, d)
    return forecast.forecast(matrix, given, bent, regions, NAMES, testbed.SETTINGS.display_timezone, at)


def fixed_forecast(s, d):
    """From each region's last origin."""
    made = _forecast(s, d)
    return made.select("region_id", "display_name", micros("origin_hour").alias("origin_hour_us"), micros("origin_local").alias("origin_local_us"), "horizon", F.round("probability", 9).alias("probability"))


#: An instant within the calendar of every region of the given tables.
ASKED_AT = "2024-01-24 07:35:00"


def fixed_forecast_at(s, d):
    """From the hour of a given instant, for the regions whose calendar has it."""
    matrix, given, bent, regions = _given(s, d)
    hour = F.date_trunc("hour", F.lit(ASKED_AT).cast("timestamp"))
    there = matrix.filter(F.col("origin_hour") == hour).select("region_id")
    made = forecast.forecast(matrix.join(there, "region_id", "left_semi"), given, bent, regions, NAMES, testbed.SETTINGS.display_timezone, ASKED_AT)
    return made.select("region_id", micros("origin_hour").alias("origin_hour_us"), "horizon", F.round("probability", 9).alias("probability"))


def fixed_listing(s, d):
    return forecast.listing(_forecast(s, d))


def _double(v: float) -> str:
    return f"({v!r})::DOUBLE"


def _margin(k: int) -> str:
    r, text = rule(k), _double(rule(k)["intercept"])
    for i, name in enumerate(NAMES):
        text = f"({text} + (coalesce({name}::DOUBLE, {_double(r['medians'][i])}) - {_double(r['means'][i])}) / {_double(r['scales'][i])} * {_double(r['coefs'][i])})"
    return text


def _calibrated() -> str:
    steps = " ".join(
        f"WHEN raw < {_double(x1)} THEN {_double(y0)} + ({_double(y1)} - {_double(y0)}) * (raw - {_double(x0)}) / ({_double(x1)} - {_double(x0)})" for x0, x1, y0, y1 in zip(KNOTS_X, KNOTS_X[1:], KNOTS_Y, KNOTS_Y[1:], strict=False)
    )
    isotonic = f"CASE WHEN raw < {_double(KNOTS_X[0])} THEN {_double(KNOTS_Y[0])} {steps} ELSE {_double(KNOTS_Y[-1])} END"
    return f"CASE horizon % 3 WHEN 0 THEN {isotonic} WHEN 1 THEN 1 / (1 + exp(-({_double(SIGMOID[0])} * raw + {_double(SIGMOID[1])}))) ELSE raw END"


def oracle_sql(pred: str, matrix: str) -> dict[str, str]:
    """The SQL, from the library's chains of common table expressions up to baseline predictions and the matrix."""

    def model_rows(rows: str) -> str:
        each = " UNION ALL ".join(f"SELECT region_id, t, {k} AS horizon, y_{k} AS y, 1 / (1 + exp(-{_margin(k)})) AS raw FROM {rows}" for k in HORIZONS)
        return f"mr AS ({each}), mo AS (SELECT *, {_calibrated()} AS p FROM mr)"

    eps = f"{metrics.EPSILON!r}::DOUBLE"
    scores = f"""{pred}, tm AS (SELECT * FROM matrix WHERE split = 'test'), {model_rows("tm")},
        al AS (SELECT region_id, horizon, 'model' AS predictor, y, p FROM mo UNION ALL SELECT region_id, horizon, predictor, y, p FROM lp),
        q AS (SELECT *, least(greatest(p, {eps}), 1 - {eps}) AS q FROM al),
        pl AS (SELECT region_id, horizon, predictor, count(*)::BIGINT AS n_samples, avg(y) AS positive_rate, avg((p - y) * (p - y)) AS brier_score, avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)) AS log_loss FROM q GROUP BY ALL),
        tied AS (SELECT region_id, horizon, predictor, p, count(*) AS n, sum(y) AS hits FROM al GROUP BY ALL),
        ran AS (SELECT *, sum(n) OVER w AS seen, sum(hits) OVER w AS found FROM tied WINDOW w AS (PARTITION BY region_id, horizon, predictor ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        ap AS (SELECT region_id, horizon, predictor, CASE WHEN sum(hits) > 0 AND sum(hits) < sum(n) THEN round(sum(hits::DOUBLE * found::DOUBLE / seen::DOUBLE) / sum(hits)::DOUBLE, 6) ELSE -1.0::DOUBLE END AS pr_auc FROM ran GROUP BY ALL)"""
    latest = f"{matrix}, lm AS (SELECT * FROM matrix QUALIFY t = max(t) OVER (PARTITION BY region_id)), {model_rows('lm')}"
    local = "timezone('Europe/Kyiv', timezone('UTC', t))"
    return {
        "fixed_predictions": f"WITH {matrix}, tm AS (SELECT * FROM matrix WHERE split = 'test'), {model_rows('tm')} SELECT region_id, epoch_us(t) AS origin_hour_us, horizon, round(raw, 9) AS raw, round(p, 9) AS p FROM mo",
        "fixed_report": f"""WITH {scores} SELECT pl.region_id, pl.horizon, pl.predictor, pl.n_samples, round(pl.positive_rate, 6) AS positive_rate, round(pl.brier_score, 6) AS brier_score, round(pl.log_loss, 6) AS log_loss,
            round(pl.brier_score - o.brier_score, 6) AS model_uplift, pr_auc FROM pl JOIN ap USING (region_id, horizon, predictor) JOIN pl o ON o.region_id = pl.region_id AND o.horizon = pl.horizon AND o.predictor = 'model'""",
        "fixed_forecast": f"WITH {latest} SELECT region_id, upper(region_id) AS display_name, epoch_us(t) AS origin_hour_us, epoch_us({local}) AS origin_local_us, horizon, round(p, 9) AS probability FROM mo",
        "fixed_forecast_at": f"WITH {matrix}, am AS (SELECT * FROM matrix WHERE t = date_trunc('hour', TIMESTAMP '{ASKED_AT}')), {model_rows('am')} SELECT region_id, epoch_us(t) AS origin_hour_us, horizon, round(p, 9) AS probability FROM mo",
        "fixed_listing": f"WITH {latest} SELECT region_id, horizon, upper(region_id) || '  ' || strftime({local}, '%Y-%m-%d %H:%M') || '  +' || horizon || 'h  ' || printf('%.2f', p) AS line FROM mo",
    }


QUERIES = {f.__name__: f for f in (fixed_predictions, fixed_report, fixed_forecast, fixed_forecast_at, fixed_listing)}
