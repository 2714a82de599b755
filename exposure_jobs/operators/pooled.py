"""Medians, logistic fits and isotonic calibration of groups of any size: what has to meet in one place are sums, never a group's rows.

The operators of ``model`` send a region's rows to one task, which the calendar bounds. These give the same results for keys without such
a bound, one model for all regions above all (:func:`as_one_region`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure_jobs.functions.durable import checkpointed, shuffle_partitions, small_side
from exposure_jobs.functions.solvers import pool_blocks
from exposure_jobs.operators.features import matrix_features
from exposure_jobs.operators.model import CALIBRATION, CERTAIN, PARAMETERS
from exposure_jobs.operators.panel import label_columns
from exposure_jobs.operators.running import running


def as_one_region(matrix: DataFrame, name: str = "all") -> DataFrame:
    """The matrix with all regions under one name, so that what is fitted by region is fitted over all of them."""
    return matrix.withColumn("region_id", F.lit(name))


def exact_medians(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, feature, median)`` over the values that are there; a feature without any is missing.

    Equal values are counted before they are shuffled, running counts (:func:`running`) say where the middle ranks lie, and those one or
    two values make the median.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns)))
    long = rows.select(*keys, each.alias("e")).select(*keys, "e.feature", "e.value").filter("value IS NOT NULL")
    counted = checkpointed(long.groupBy(*keys, "feature", "value").agg(F.count("*").alias("n")))
    group = [*keys, "feature"]
    ran = running(counted, group, ["value"], {"upto": ("sum", "n")})
    total = small_side(counted.groupBy(*group).agg(F.sum("n").alias("total")))
    joined = ran.join(total, group)
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto")), F.col("value")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return joined.groupBy(*group).agg(((at(low) + at(high)) / 2).alias("median"))


def exact_imputation(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``(keys, medians, means, scales, there, n_fit)``: exact medians, then means and population deviations of the imputed values (a
    deviation of zero scales by one), as arrays in the order of ``features``."""
    medians = exact_medians(rows, keys, features)
    wide = medians.groupBy(*keys).agg(*(F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"__m{i}") for i, f in enumerate(features)))
    joined = rows.select(*keys, *features).join(small_side(wide), keys, "left")
    filled = [F.coalesce(F.col(f).cast("double"), F.col(f"__m{i}"), F.lit(0.0)).alias(f"__v{i}") for i, f in enumerate(features)]
    middle = [F.col(f"__m{i}") for i in range(len(features))]
    stats = joined.select(*keys, *middle, *filled).groupBy(*keys).agg(
        *(F.first(m).alias(f"__m{i}") for i, m in enumerate(middle)),
        *(F.avg(f"__v{i}").alias(f"__a{i}") for i in range(len(features))),
        *(F.stddev_pop(f"__v{i}").alias(f"__d{i}") for i in range(len(features))),
        F.count("*").alias("n_fit"),
    )
    column = lambda make: F.array(*(make(i) for i in range(len(features))))
    return stats.select(
        *keys,
        column(lambda i: F.coalesce(F.col(f"__m{i}"), F.lit(0.0))).alias("medians"),
        column(lambda i: F.col(f"__a{i}")).alias("means"),
        column(lambda i: F.when(F.col(f"__d{i}") > 0, F.col(f"__d{i}")).otherwise(1.0)).alias("scales"),
        column(lambda i: F.col(f"__m{i}").isNotNull()).alias("there"),
        "n_fit",
    )


#: So many fits, one for each key and label, may share a pass: their coefficients go along with the tasks and their sums come to the driver.
MOST_FITS = 10_000


def distributed_logistic(rows: DataFrame, keys: list[str], z: list[str], weights: dict[tuple, tuple[float, float]], base: str | None = None, c: float = 1.0, steps: int = 50) -> dict[tuple, np.ndarray]:
    """``rows(keys, z, labels, base)`` → (key..., label) → coefficients and intercept of a weighted logistic regression with an L2 penalty
    on the coefficients (strength 1 / c), for every pair that ``weights`` (of label 0, of label 1) names.

    A Newton step is one pass: each task multiplies its batches out to the loss, gradient and Hessian of each fit, Spark adds these up by
    fit, and what is left to solve is as small as the number of features, however many rows there are. A trial that does not lower the
    loss is taken back by halves. Sums over many rows carry their rounding, so losses compare, and steps end, with that much slack. At
    most MOST_FITS fits: with more keys a key's rows are few, and ``model.fit_exposure_models`` is the way. ``rows`` is read once a step.
    """
    if len(weights) > MOST_FITS:
        raise ValueError(f"{len(weights)} fits at once; fit regions apart")
    width = len(z) + 1
    upper, penalty = np.triu_indices(width), np.r_[np.full(len(z), 1.0 / c), 0.0]
    best = {fit: (np.inf, np.zeros(width)) for fit in weights}
    trial, step, size, open_ = {fit: np.zeros(width) for fit in weights}, {}, dict.fromkeys(weights, 1.0), set(weights)
    for _ in range(steps):
        asked = {}
        for fit in open_:
            asked.setdefault(fit[:-1], []).append((fit[-1], trial[fit], *weights[fit]))
        for fit, sums in _newton_sums(rows, keys, z, base, asked).items():
            loss, at = sums[0] + 0.5 * penalty @ trial[fit] ** 2, trial[fit]
            if loss > best[fit][0] + 1e-10 * abs(best[fit][0]) and size[fit] > 1e-8:
                size[fit] /= 2
                trial[fit] = best[fit][1] - size[fit] * step[fit]
                continue
            hessian = np.zeros((width, width))
            hessian[upper] = sums[1 + width :]
            hessian += np.triu(hessian, 1).T + np.diag(penalty + 1e-12)
            best[fit] = (loss, at)
            step[fit] = np.linalg.solve(hessian, sums[1 : 1 + width] + penalty * at)
            if np.abs(step[fit]).max() < 1e-9 or size[fit] <= 1e-8:
                open_.discard(fit)
            trial[fit], size[fit] = at - step[fit], 1.0
        if not open_:
            break
    return {fit: w for fit, (_, w) in best.items()}


def _newton_sums(rows: DataFrame, keys: list[str], z: list[str], base: str | None, asked: dict[tuple, list]) -> dict[tuple, np.ndarray]:
    """(key..., label) → loss, gradient and upper half of the Hessian at the asked coefficients, one after the other."""
    width = len(z) + 1
    length = 1 + width + width * (width + 1) // 2
    labels = sorted({label for fits in asked.values() for label, *_ in fits})
    columns = list(dict.fromkeys([*keys, *z, *([base] if base else []), *labels]))
    key_types = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys)
    upper = np.triu_indices(width)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([*(batch[c].to_numpy(zero_copy_only=False).astype(float) for c in z), np.ones(batch.num_rows)])
            ys = {label: batch[label].to_numpy(zero_copy_only=False).astype(float) for label in labels}
            rest = batch[base].to_numpy(zero_copy_only=False) if base else np.ones(batch.num_rows)
            names = pd.MultiIndex.from_arrays([batch[k].to_pylist() for k in keys])
            which, found = pd.factorize(names)
            for number, key in enumerate(found):
                at = slice(None) if len(found) == 1 else np.flatnonzero(which == number)
                own = x[at]
                for label, w, w0, w1 in asked.get(tuple(key), ()):
                    y = ys[label][at]
                    weight = np.where(y == 1, w1, w0) * rest[at]
                    m = own @ w
                    p = 1 / (1 + np.exp(-m))
                    sums = np.r_[weight @ (np.logaddexp(0, m) - y * m), own.T @ (weight * (p - y)), ((own * (weight * p * (1 - p))[:, None]).T @ own)[upper]]
                    fit = (*key, label)
                    total[fit] = total[fit] + sums if fit in total else sums
        made = list(total.items())
        arrays = [pa.array([fit[i] for fit, _ in made], schema_types[i]) for i in range(len(keys))] + [pa.array([fit[-1] for fit, _ in made], pa.string()), pa.array([s.tolist() for _, s in made], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, [*keys, "__label", "__sums"])

    schema_types = [pa.string() if t == "string" else pa.int64() if t == "bigint" else pa.int32() for k, t in rows.select(*keys).dtypes]
    partial = rows.select(*columns).mapInArrow(multiply, f"{key_types}, __label string, __sums array<double>")
    whole = partial.groupBy(*keys, "__label").agg(F.array(*(F.sum(F.col("__sums")[i]) for i in range(length))).alias("s"))
    return {(*(r[k] for k in keys), r["__label"]): np.array(r["s"]) for r in whole.collect()}


def fit_distributed(matrix: DataFrame, fit_rows: str = "in_primary_train", older_weight: float | None = None, constant_single_class: bool = False) -> DataFrame:
    """The parameters of :func:`model.fit_exposure_models`, by :func:`distributed_logistic`: for regions of any number of hours.

    A horizon whose labels are all alike fails, or with ``constant_single_class`` gets a model that always says so.
    """
    features, labels = matrix_features(matrix.columns), label_columns(matrix.columns)
    taken = matrix.filter(fit_rows) if older_weight is None else matrix.filter("split = 'train'")
    base = F.lit(1.0) if older_weight is None else F.when(F.col("in_primary_train"), 1.0).otherwise(older_weight)
    taken = checkpointed(taken.select("region_id", base.alias("__base"), *features, *labels))
    scaling = small_side(exact_imputation(taken, ["region_id"], features))
    x = [F.coalesce(F.col(f).cast("double"), F.col("medians")[i]) for i, f in enumerate(features)]
    z = [F.when(F.col("there")[i], (v - F.col("means")[i]) / F.col("scales")[i]).otherwise(0.0).alias(f"z{i}") for i, v in enumerate(x)]
    scaled = checkpointed(taken.join(scaling, "region_id").select("region_id", "__base", *z, *labels))
    counts = scaled.groupBy("region_id").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in labels)).limit(MOST_FITS + 1).collect()
    weights, alike = {}, []
    for r in counts:
        for y in labels:
            if 0 < r[y] < r["n"]:
                weights[r["region_id"], y] = (r["n"] / (2 * (r["n"] - r[y])), r["n"] / (2 * r[y]))
            elif constant_single_class:
                alike.append((r["region_id"], int(y[2:]), [0.0] * len(features), CERTAIN if r[y] else -CERTAIN, "constant"))
            else:
                raise ValueError(f"{r['region_id']}, {y}: the labels are all alike")
    fits = distributed_logistic(scaled, ["region_id"], [f"z{i}" for i in range(len(features))], weights, "__base")
    made = [(region, int(y[2:]), w[:-1].tolist(), float(w[-1]), "fitted") for (region, y), w in fits.items()]
    found = matrix.sparkSession.createDataFrame(made + alike, "region_id string, horizon int, coefs array<double>, intercept double, status string")
    names = [c.split()[0] for c in PARAMETERS.split(", ")]
    return found.join(scaling, "region_id").withColumn("features", F.array(*map(F.lit, features))).select(*names)


def isotonic_blocks(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """``labelled(keys, p, y)`` → ``(keys, low, high, level)``: the level stretches of the non-decreasing least-squares fit of y on p.

    Equal p are counted first. Each range of p is pooled on its own, then what is left of all ranges of a key is pooled once more, which
    is exact: blocks that one range pools stay together in the whole fit. Distinct levels of n zeros and ones are at most about n to the
    power two thirds (their denominators add up to n), so what meets in one task stays far smaller than the group.
    """
    tied = labelled.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("y").cast("double").alias("hits"))
    ranges = tied.repartitionByRange(shuffle_partitions(labelled.sparkSession), *keys, "p").withColumn("__range", F.spark_partition_id())
    ranges = checkpointed(ranges)
    key_types = ", ".join(f"`{k}` {t}" for k, t in ranges.dtypes if k in keys)
    block = "low double, high double, n double, hits double"

    def pool(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low")
        low, high, n, hits = pool_blocks(*(frame[c].to_numpy(float) for c in ("low", "high", "n", "hits")))
        made = pd.DataFrame({"low": low, "high": high, "n": n, "hits": hits})
        for k in keys:
            made[k] = frame[k].iloc[0]
        return made[[*keys, "low", "high", "n", "hits"]]

    points = ranges.select(*keys, "__range", F.col("p").alias("low"), F.col("p").alias("high"), F.col("n").cast("double").alias("n"), "hits")
    part = points.groupBy(*keys, "__range").applyInPandas(pool, f"{key_types}, {block}")
    whole = part.groupBy(*keys).applyInPandas(pool, f"{key_types}, {block}")
    return whole.select(*keys, "low", "high", (F.col("hits") / F.col("n")).alias("level"))


def fit_calibrators_distributed(labelled: DataFrame, method: str = "isotonic") -> DataFrame:
    """The calibrators of :func:`model.fit_calibrators` for groups of any size: isotonic by mergeable blocks, sigmoid by sums."""
    if method not in ("isotonic", "sigmoid"):
        raise ValueError(f"unknown calibration {method!r}")
    keys = ["region_id", "horizon"]
    rows = checkpointed(labelled.select(*keys, F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)).alias("p"), F.col("y").cast("double").alias("y")))
    kinds = small_side(rows.groupBy(*keys).agg((F.min("y") < F.max("y")).alias("two")))
    nothing = F.array().cast("array<double>")
    alike = kinds.filter(~F.col("two")).select(*keys, F.lit("identity").alias("method"), nothing.alias("knots_x"), nothing.alias("knots_y"))
    rows = rows.join(kinds.filter("two").drop("two"), keys)
    if method == "sigmoid":
        both = {(r["region_id"], r["horizon"], "y"): (1.0, 1.0) for r in kinds.filter("two").limit(MOST_FITS + 1).collect()}
        fits = [(region, horizon, method, [float(w[0])], [float(w[1])]) for (region, horizon, _), w in distributed_logistic(rows, keys, ["p"], both).items()]
        made = labelled.sparkSession.createDataFrame(fits, CALIBRATION)
    else:
        blocks = F.sort_array(F.collect_list(F.struct("low", "high", "level")))  # a calibrator, as it is stored
        bent = isotonic_blocks(rows, keys).groupBy(*keys).agg(blocks.alias("b"))
        ends = lambda make: F.flatten(F.transform("b", lambda b: F.when(b["low"] == b["high"], F.array(make(b, "low"))).otherwise(F.array(make(b, "low"), make(b, "high")))))
        made = bent.select(*keys, F.lit(method).alias("method"), ends(lambda b, c: b[c]).alias("knots_x"), ends(lambda b, c: b["level"]).alias("knots_y"))
    names = [c.split()[0] for c in CALIBRATION.split(", ")]
    return made.unionByName(alike).select(*names)
