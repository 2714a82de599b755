"""Logistic models for each region and horizon as rows of parameters, their calibration, and prediction by column arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure_jobs.functions.solvers import newton_logistic, newton_logistic_many, pool_blocks
from exposure_jobs.operators.features import matrix_features
from exposure_jobs.operators.panel import label_columns

PARAMETERS = "region_id string, horizon int, features array<string>, medians array<double>, means array<double>, scales array<double>, coefs array<double>, intercept double, n_fit long, status string"
CALIBRATION = "region_id string, horizon int, method string, knots_x array<double>, knots_y array<double>"


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def arrow_schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def imputation(matrix: DataFrame, features: list[str], fit_rows: str = "in_primary_train") -> DataFrame:
    """Medians of the fit rows, then means and population deviations of the imputed values; long by feature."""
    rows = matrix.filter(fit_rows)
    medians = rows.groupBy("region_id").agg(*(F.median(F.col(f).cast("double")).alias(f"__{f}") for f in features))
    joined = rows.select("region_id", *features).join(medians, "region_id")
    filled = [F.coalesce(F.col(f).cast("double"), F.col(f"__{f}"), F.lit(0.0)).alias(f) for f in features]
    stats = joined.select("region_id", *(F.col(f"__{f}") for f in features), *filled).groupBy("region_id").agg(
        *(F.struct(F.first(f"__{f}").alias("median"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("deviation")).alias(f) for f in features)
    )
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("s")) for f in features))
    return stats.select("region_id", F.explode(each).alias("e")).select("region_id", "e.feature", "e.s.*")


def class_weights(matrix: DataFrame, horizons: list[int], fit_rows: str = "in_primary_train") -> DataFrame:
    """Balanced weights n / (2 n_class) by region and horizon; null for a class that is not there."""
    each = F.array(*(F.struct(F.lit(k).alias("horizon"), F.col(f"y_{k}").alias("y")) for k in horizons))
    rows = matrix.filter(fit_rows).select("region_id", F.explode(each).alias("e")).groupBy("region_id", "e.horizon").agg(F.count("*").alias("n"), F.sum("e.y").alias("pos"))
    weight = lambda c: F.when(c > 0, F.col("n") / (2 * F.when(c > 0, c)))
    return rows.select("region_id", "horizon", "n", weight(F.col("n") - F.col("pos")).alias("weight_0"), weight(F.col("pos")).alias("weight_1"))


#: The margin of a constant model: a probability of 0 or 1 as far as six digits go.
CERTAIN = 35.0


def fit_exposure_models(matrix: DataFrame, fit_rows: str = "in_primary_train", older_weight: float | None = None, constant_single_class: bool = False) -> DataFrame:
    """One row of parameters for each region and horizon. A region's rows go to one task once (its primary window, or with
    ``older_weight`` all its training hours) and all its horizons share the imputed, scaled matrix.

    A horizon whose labels are all alike fails, or with ``constant_single_class`` gets a model that always says so (``status`` is then
    ``constant``, else ``fitted``). With ``older_weight`` training rows before the primary window take part with that weight.
    """
    features, labels = matrix_features(matrix.columns), label_columns(matrix.columns)
    rows = matrix.filter(fit_rows) if older_weight is None else matrix.filter("split = 'train'")

    horizons = [int(y[2:]) for y in labels]

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("origin_hour")  # sums in one order
        column = lambda c, to=np.float64: table[c].to_numpy().astype(to)
        x, region = np.column_stack([column(f) for f in features]), table["region_id"][0].as_py()
        base = np.ones(len(x)) if older_weight is None else np.where(column("in_primary_train", bool), 1.0, older_weight)
        missing = np.isnan(x)
        there, medians = ~missing.all(0), np.zeros(x.shape[1])
        for gaps, names in ((False, there & ~missing.any(0)), (True, there & missing.any(0))):
            if names.any():
                medians[names] = (np.nanmedian if gaps else np.median)(x[:, names], axis=0)
        x = np.where(missing, medians, x)
        mean, deviation = x.mean(0), x.std(0)
        scale = np.where(deviation > 0, deviation, 1.0)
        z = np.where(there, (x - mean) / scale, 0.0)  # a feature that is always missing gets no coefficient
        y = np.column_stack([column(label) for label in labels])
        n, hits, alike = len(y), y.sum(0), y.min(0) == y.max(0)
        if alike.any() and not constant_single_class:
            raise ValueError(f"{region}, {labels[int(np.argmax(alike))]}: the labels are all alike")
        coefs, free = np.zeros((len(labels), len(features))), np.where(y[0] != 0, CERTAIN, -CERTAIN)
        if not alike.all():
            y, hits = y[:, ~alike], hits[~alike]
            coefs[~alike], free[~alike] = newton_logistic_many(z, y, np.where(y == 1, n / (2 * hits), n / (2 * (n - hits))) * base[:, None])
        k = len(labels)
        made = [[region] * k, horizons, [features] * k, *([v.tolist()] * k for v in (medians, mean, scale)), coefs.tolist(), free.tolist(), [n] * k, ["constant" if a else "fitted" for a in alike]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

    arrow = arrow_schema(PARAMETERS)
    return rows.select("region_id", "origin_hour", *([] if older_weight is None else ["in_primary_train"]), *features, *labels).groupBy("region_id").applyInArrow(fit, PARAMETERS)


def predict_raw(rows: DataFrame, parameters: DataFrame, features: list[str], horizons: list[int] | None = None, calibrators: DataFrame | None = None) -> DataFrame:
    """``(region_id, origin_hour, horizon, p)`` for all rows and horizons, with the label ``y`` of the row for ``horizons``; a missing
    feature column is an error. Labels ride along with their row, so nothing is joined back. With ``calibrators``, p is that of :func:`calibrated`: they meet the
    parameters, not the predictions, which then stay where their region lies."""
    if missing := sorted(set(features) - set(rows.columns)):
        raise ValueError(f"missing features {missing}")
    x = F.array(*(F.col(f).cast("double") for f in features))
    if calibrators is not None:
        parameters = parameters.join(calibrators, ["region_id", "horizon"], "left")
    labels = [] if horizons is None else [F.array(*(F.col(f"y_{k}") for k in horizons)).alias("labels")]
    joined = rows.select("region_id", "origin_hour", x.alias("x"), *labels).join(parameters, "region_id")
    at = lambda c, i: F.get(c, F.lit(i))
    terms = ((F.coalesce(at("x", i), at("medians", i)) - at("means", i)) / at("scales", i) * at("coefs", i) for i in range(len(features)))
    margin = reduce(lambda t, v: t + v, terms, F.col("intercept"))  # term by term: compiled, which functions over arrays are not
    own = [] if horizons is None else [F.element_at("labels", F.array_position(F.array(*map(F.lit, horizons)), F.col("horizon")).cast("int")).alias("y")]
    kept = [] if calibrators is None else ["method", "knots_x", "knots_y"]
    made = joined.select("region_id", "origin_hour", "horizon", *own, (1 / (1 + F.exp(-margin))).alias("p"), *kept)
    return made if calibrators is None else made.withColumn("p", _bent()).drop(*kept)


def gradients(matrix: DataFrame, parameters: DataFrame, fit_rows: str = "in_primary_train") -> DataFrame:
    """``(region_id, horizon, status, steepest)``: the greatest component of the fit's gradient at the returned coefficients.

    Recomputed row by row from the written objective, apart from the solver: at the optimum it is zero.
    """
    features, labels = matrix_features(matrix.columns), label_columns(matrix.columns)
    horizons = [int(c[2:]) for c in labels]
    rows = matrix.filter(fit_rows)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.col(f"y_{k}").cast("double").alias("y")) for k in horizons))).alias("e")
    x = F.array(*(F.col(f).cast("double") for f in features)).alias("x")
    met = rows.select("region_id", x, each).select("region_id", "x", "e.*").join(parameters, ["region_id", "horizon"]).join(class_weights(matrix, horizons, fit_rows).drop("n"), ["region_id", "horizon"])
    z = F.transform(F.zip_with(F.zip_with("x", "medians", lambda a, m: F.coalesce(a, m)), "means", lambda a, m: a - m), lambda d, i: d / F.col("scales")[i])
    met = met.select("region_id", "horizon", "status", "coefs", "intercept", "y", F.when(F.col("y") == 1, F.col("weight_1")).otherwise(F.col("weight_0")).alias("w"), z.alias("z"))
    margin = F.aggregate(F.zip_with("z", "coefs", lambda a, w: a * w), F.col("intercept"), lambda t, v: t + v)
    pull = met.select("region_id", "horizon", "status", "coefs", "z", (F.col("w") * (1 / (1 + F.exp(-margin)) - F.col("y"))).alias("r"))
    sums = pull.groupBy("region_id", "horizon", "status").agg(F.first("coefs").alias("coefs"), F.sum("r").alias("free"), F.array(*(F.sum(F.col("r") * F.col("z")[i]) for i in range(len(features)))).alias("g"))
    steepest = F.greatest(F.abs("free"), F.array_max(F.transform(F.zip_with("g", "coefs", lambda a, w: a + w), F.abs)))
    return sums.select("region_id", "horizon", "status", steepest.alias("steepest"))


def fit_calibrators(labelled: DataFrame, method: str = "isotonic") -> DataFrame:
    """``(region_id, horizon, p, y)`` of validation rows → a calibrator for each region and horizon.

    Labels of one class give the identity; ``isotonic`` knots of the non-decreasing fit; ``sigmoid`` the two numbers of a logistic
    fit on the probability itself. A region's validation rows go to one task (a few weeks of hours for each horizon).
    """
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"unknown calibration {method!r}")
    rows = labelled.select("region_id", "horizon", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)).alias("p"), F.col("y").cast("double").alias("y"))
    if method == "isotonic":
        return isotonic_calibrators(rows.groupBy("region_id", "horizon", "p").agg(F.count("*").alias("n"), F.sum("y").alias("hits")))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        made = []
        for (region, horizon), part in frame.groupby(["region_id", "horizon"]):
            p, y = part["p"].to_numpy(), part["y"].to_numpy()
            if y.min() == y.max():
                made.append((region, int(horizon), "identity", [], []))
            else:
                w, b = newton_logistic(p.reshape(-1, 1), y, np.ones(len(y)))
                made.append((region, int(horizon), method, [float(w[0])], [b]))
        return pd.DataFrame(made, columns=["region_id", "horizon", "method", "knots_x", "knots_y"])

    return rows.groupBy("region_id").applyInPandas(fit, CALIBRATION)


def isotonic_calibrators(counted: DataFrame) -> DataFrame:
    """``counted(region_id, horizon, p, n, hits)``, a row for each different p → isotonic calibrators, as :func:`fit_calibrators` makes them:
    only different scores are sorted and leave Spark, a batch of regions and horizons at a time."""
    points = F.sort_array(F.collect_list(F.struct("p", F.col("n").cast("double").alias("n"), F.col("hits").cast("double").alias("hits"))))
    gathered = counted.groupBy("region_id", "horizon").agg(points.alias("x")).select("region_id", F.col("horizon").cast("int").alias("horizon"), "x.p", "x.n", "x.hits")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.r_[0, np.cumsum(batch["p"].value_lengths().to_numpy())]
            p, n, hits = (batch[c].flatten().to_numpy() for c in ("p", "n", "hits"))
            method, knots_x, knots_y = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                total = hits[a:b].sum()
                if total == 0 or total == n[a:b].sum():
                    method.append("identity")
                    knots_x.append([])
                    knots_y.append([])
                    continue
                blocks = list(zip(*(v.tolist() for v in pool_blocks(p[a:b], p[a:b], n[a:b], hits[a:b])), strict=True))
                bends = [(x, h / m) for low, high, m, h in blocks for x in ((low,) if low == high else (low, high))]  # a level stretch needs its ends only
                method.append("isotonic")
                knots_x.append([x for x, _ in bends])
                knots_y.append([y for _, y in bends])
            made = (batch["region_id"], batch["horizon"], method, knots_x, knots_y)
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)

    arrow = arrow_schema(CALIBRATION)
    return gathered.mapInArrow(fit, CALIBRATION)


def calibrated(predictions: DataFrame, calibrators: DataFrame) -> DataFrame:
    """``predictions`` with p calibrated; a region and horizon without a calibrator keeps the raw p."""
    joined = predictions.join(calibrators, ["region_id", "horizon"], "left")
    return joined.withColumn("p", _bent()).select(*predictions.columns)


def _bent() -> Column:
    """p as ``method`` and knots beside it say."""
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    sigmoid = 1 / (1 + F.exp(-(F.element_at("knots_x", 1) * p + F.element_at("knots_y", 1))))
    return F.when(F.col("method") == "isotonic", _interpolated(p)).when(F.col("method") == "sigmoid", sigmoid).when(F.col("method") == "identity", p).otherwise(F.col("p"))


def _interpolated(p: Column) -> Column:
    """Linear between knots, level beyond them."""
    x = lambda i: F.element_at("knots_x", i)
    y = lambda i: F.element_at("knots_y", i)

    def between(at: Column) -> Column:
        inside = y(at) + (y(at + 1) - y(at)) * (p - x(at)) / (x(at + 1) - x(at))
        return F.when(at == 0, y(F.lit(1))).when(at == F.size("knots_x"), y(at)).otherwise(inside)

    below = F.size(F.filter("knots_x", lambda k: k <= p))
    return F.element_at(F.transform(F.array(below), between), 1)  # bound once, not searched for each use
