"""Registered queries over all regions as one: groups that hold every row, by the operators that need no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure_jobs.functions.durable import checkpointed
from exposure_jobs.jobs import testbed
from exposure_jobs.operators import baselines, features, metrics, model, pooled

HORIZONS = testbed.SETTINGS.horizons


def _matrix(s, d) -> DataFrame:
    return pooled.as_one_region(testbed.tables(s, d).matrix)


def _scored(s, d, split: str = "test") -> DataFrame:
    """``(horizon, predictor, y, p)`` of all regions: the three baselines and their mean, which has far more distinct scores."""
    made = baselines.train_and_predict(testbed.tables(s, d).matrix, list(HORIZONS), split)
    laid = made.select(F.array(*(f"y_{k}" for k in HORIZONS)).alias("ys"), *(F.array(*(f"pred_{b}_y_{k}" for k in HORIZONS)).alias(b) for b in baselines.NAMES))
    each = laid.select("ys", *baselines.NAMES, F.posexplode(F.array(*map(F.lit, HORIZONS))).alias("at", "horizon"))
    each = each.select("horizon", F.get("ys", "at").alias("y"), *(F.round(F.get(b, "at"), 9).alias(b) for b in baselines.NAMES))
    each = each.withColumn("mean", F.round((F.col("marginal") + F.col("seasonal") + F.col("persistence")) / 3, 8))
    picked = F.array(*(F.struct(F.lit(b).alias("predictor"), F.col(b).alias("p")) for b in (*baselines.NAMES, "mean")))
    return each.select("horizon", "y", F.explode(picked).alias("e")).select("horizon", "e.predictor", "y", "e.p")


def pooled_medians(s, d):
    """Exact medians of every feature over all rows."""
    made = _matrix(s, d).withColumns({c: F.round(c, 6) for c in ("time_since_last_start_h", "time_since_last_end_h")})
    found = pooled.exact_medians(made, ["region_id"], features.matrix_features(made.columns))
    return found.select("feature", F.round("median", 9).alias("median"))


def pooled_scores(s, d):
    """All metrics of each horizon and predictor over the test rows of all regions."""
    made = metrics.evaluate(_scored(s, d), ["horizon", "predictor"], spread=True)
    rest = [F.round(c, 6).alias(c) for c in ("positive_rate", "brier_score", "log_loss")]
    return made.select("horizon", "predictor", "n_samples", *rest, F.round(F.nanvl("pr_auc", F.lit(-1.0)), 6).alias("pr_auc"))


def pooled_average_precision(s, d):
    found = metrics.average_precision(_scored(s, d), ["horizon", "predictor"], spread=True)
    return found.select("horizon", "predictor", F.round(F.nanvl("pr_auc", F.lit(-1.0)), 6).alias("pr_auc"))


def pooled_threshold(s, d):
    found = metrics.false_alarm_threshold(_scored(s, d), ["horizon", "predictor"], 0.1, spread=True)
    return found.select("horizon", "predictor", F.round("threshold", 8).alias("threshold"), F.round("recall", 6).alias("recall"))


def pooled_isotonic(s, d):
    """What one calibrator a horizon, fitted over all regions' validation rows, makes of the persistence scores."""
    rows = checkpointed(_scored(s, d, "validation").filter("predictor = 'persistence'").select(F.lit("all").alias("region_id"), "horizon", "p", "y"))
    points = rows.select("region_id", "horizon", "p").distinct().withColumn("x", F.col("p"))
    done = model.calibrated(points, pooled.fit_calibrators_distributed(rows))
    return done.select("horizon", F.round("x", 9).alias("x"), F.round("p", 9).alias("fitted"))


def pooled_stationary(s, d):
    """One model a horizon over all regions' primary training rows, fitted by sums: is each at the optimum of its objective? The gradient is
    recomputed from the rows, and taken per row."""
    matrix = checkpointed(_matrix(s, d).filter("in_primary_train"))
    found = model.gradients(matrix, pooled.fit_distributed(matrix, constant_single_class=True))
    return found.filter("status = 'fitted'").select("horizon", "status", (F.col("steepest") < 1e-6 * matrix.count()).alias("stationary"))


def oracle_sql(pred: str, rates: str, matrix: str) -> dict[str, str]:
    """The SQL, from the library's chain of common table expressions up to baseline predictions, rates and the matrix."""
    names = features.feature_columns(testbed.SETTINGS.lag_hours)
    columns = ", ".join(f"{f}::DOUBLE" for f in names)
    long = f"""{pred},
        three AS (SELECT t, region_id, horizon, y, round(marginal, 9) AS marginal, round(seasonal, 9) AS seasonal, round(persistence, 9) AS persistence FROM pw),
        sc AS (SELECT horizon, 'marginal' AS predictor, y, marginal AS p FROM three UNION ALL SELECT horizon, 'seasonal', y, seasonal FROM three UNION ALL SELECT horizon, 'persistence', y, persistence FROM three
               UNION ALL SELECT horizon, 'mean', y, round((marginal + seasonal + persistence) / 3, 8) FROM three)"""
    eps = f"{metrics.EPSILON!r}::DOUBLE"
    running = """tied AS (SELECT horizon, predictor, p, count(*) AS n, sum(y) AS hits FROM sc GROUP BY ALL),
        ran AS (SELECT *, sum(n) OVER w AS seen, sum(hits) OVER w AS found, sum(n) OVER v AS all_n, sum(hits) OVER v AS all_hits FROM tied
                WINDOW w AS (PARTITION BY horizon, predictor ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY horizon, predictor))"""
    precision = "CASE WHEN sum(hits) > 0 AND sum(hits) < sum(n) THEN round(sum(hits::DOUBLE * found::DOUBLE / seen::DOUBLE) / sum(hits)::DOUBLE, 6) ELSE -1.0::DOUBLE END"
    labels = " UNION ALL ".join(f"SELECT {k} AS horizon, y_{k} AS y FROM matrix WHERE in_primary_train" for k in HORIZONS)
    return {
        "pooled_medians": f"WITH {matrix}, f AS (SELECT unnest([{', '.join(repr(n) for n in names)}]) AS feature, unnest([{columns}]) AS v FROM matrix) SELECT feature, round(median(v), 9) AS median FROM f WHERE v IS NOT NULL GROUP BY feature",
        "pooled_scores": f"""WITH {long}, {running}, q AS (SELECT *, least(greatest(p, {eps}), 1 - {eps}) AS q FROM sc),
            plain AS (SELECT horizon, predictor, count(*)::BIGINT AS n_samples, round(avg(y), 6) AS positive_rate, round(avg((p - y) * (p - y)), 6) AS brier_score, round(avg(-ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)), 6) AS log_loss FROM q GROUP BY ALL),
            ap AS (SELECT horizon, predictor, {precision} AS pr_auc FROM ran GROUP BY ALL) SELECT plain.*, pr_auc FROM plain JOIN ap USING (horizon, predictor)""",
        "pooled_average_precision": f"WITH {long}, {running} SELECT horizon, predictor, {precision} AS pr_auc FROM ran GROUP BY ALL",
        "pooled_threshold": f"""WITH {long}, {running} SELECT horizon, predictor, round(min(CASE WHEN seen - found <= 0.1 * (all_n - all_hits) THEN p END), 8) AS threshold,
            round(max(CASE WHEN seen - found <= 0.1 * (all_n - all_hits) AND all_hits > 0 THEN found::DOUBLE / all_hits::DOUBLE END), 6) AS recall FROM ran GROUP BY ALL""",
        "pooled_isotonic": f"""WITH {rates}, va AS ({" UNION ALL ".join(f"SELECT region_id, active_at_origin AS act, {k} AS horizon, y_{k} AS y FROM matrix WHERE split = 'validation'" for k in HORIZONS)}),
            q AS (SELECT va.horizon, va.y, round(coalesce(rp.hits::DOUBLE / rp.n, rm.hits::DOUBLE / rm.n), 9) AS x FROM va JOIN rm ON va.region_id = rm.region_id AND va.horizon = rm.horizon
                  LEFT JOIN rp ON va.region_id = rp.region_id AND va.horizon = rp.horizon AND va.act = rp.act),
            pt AS (SELECT horizon, x, count(*) AS n, sum(y) AS s FROM q GROUP BY ALL),
            pr AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(s) OVER v AS ts, sum(n) OVER v AS tn FROM pt
                   WINDOW w AS (PARTITION BY horizon ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY horizon)),
            jk AS (SELECT a.horizon, a.i AS j, k.i AS k, (k.cs - a.cs + a.s)::DOUBLE / (k.cn - a.cn + a.n)::DOUBLE AS mean FROM pr a JOIN pr k ON a.horizon = k.horizon AND k.i >= a.i),
            lo AS (SELECT horizon, j, k AS i, min(mean) OVER (PARTITION BY horizon, j ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo FROM jk),
            ft AS (SELECT horizon, i, max(lo) AS f FROM lo GROUP BY ALL)
            SELECT pr.horizon, round(x, 9) AS x, round(CASE WHEN ts = 0 OR ts = tn THEN x ELSE f END, 9) AS fitted FROM pr JOIN ft ON pr.horizon = ft.horizon AND pr.i = ft.i""",
        "pooled_stationary": f"WITH {matrix}, l AS ({labels}) SELECT horizon, 'fitted' AS status, true AS stationary FROM l GROUP BY horizon HAVING min(y) < max(y)",
    }


QUERIES = {f.__name__: f for f in (pooled_medians, pooled_scores, pooled_average_precision, pooled_threshold, pooled_isotonic, pooled_stationary)}
