"""Rate baselines: three groupings of the training rows in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposure_jobs.operators.panel import label_columns

NAMES = ("marginal", "seasonal", "persistence")


def fit_baselines(matrix: DataFrame, fit_rows: str = "split = 'train'") -> DataFrame:
    """Long rates ``(region_id, kind, hour_of_week, active, horizon, n, hits, rate)``; kind is marginal, seasonal or persistence.

    One GROUPING SETS pass with a sum for each label, then the small result is turned on its side.
    """
    labels = label_columns(matrix.columns)
    if missing := {"hour_of_week_kyiv", "active_at_origin"} - set(matrix.columns) or ({"y_*"} if not labels else set()):
        raise ValueError(f"missing columns {sorted(missing)}")
    rows = matrix.filter(fit_rows)
    how, act = F.col("hour_of_week_kyiv"), F.col("active_at_origin")
    sums = [F.sum(y).cast("bigint").alias(y) for y in labels]
    sets = rows.groupingSets([["region_id"], ["region_id", "hour_of_week_kyiv"], ["region_id", "active_at_origin"]], "region_id", how, act).agg(
        F.grouping("hour_of_week_kyiv").alias("__how"), F.grouping("active_at_origin").alias("__act"), F.count("*").alias("n"), *sums
    )
    kind = F.when(F.col("__how") == 0, "seasonal").when(F.col("__act") == 0, "persistence").otherwise("marginal")
    each = F.array(*(F.struct(F.lit(int(y[2:])).alias("horizon"), F.col(y).alias("hits")) for y in labels))
    long = sets.select("region_id", kind.alias("kind"), how.alias("hour_of_week"), act.alias("active"), "n", F.explode(each).alias("e"))
    return long.select("region_id", "kind", "hour_of_week", "active", "e.horizon", "n", "e.hits", (F.col("e.hits") / F.col("n")).alias("rate"))


def predict_baselines(rates: DataFrame, rows: DataFrame, horizons: list[int], baselines: tuple[str, ...] = NAMES) -> DataFrame:
    """``rows`` with ``pred_{baseline}_y_{N}``. A seasonal hour or a persistence side never seen takes the marginal rate.

    Rates meet the rows by region (and hour of the week or flag), turned back to one row for each key.
    """
    if unknown := sorted(set(baselines) - set(NAMES)):
        raise ValueError(f"unknown baselines {unknown}")

    def wide(kind: str, keys: list, prefix: str) -> DataFrame:
        picked = [F.max(F.when(F.col("horizon") == k, F.col("rate"))).alias(f"{prefix}{k}") for k in horizons]
        return rates.filter(F.col("kind") == kind).groupBy("region_id", *keys).agg(*picked)

    joined = rows.join(wide("marginal", [], "__m"), "region_id", "left")
    if "seasonal" in baselines:
        joined = joined.join(wide("seasonal", ["hour_of_week"], "__s").withColumnRenamed("hour_of_week", "hour_of_week_kyiv"), ["region_id", "hour_of_week_kyiv"], "left")
    if "persistence" in baselines:
        joined = joined.join(wide("persistence", ["active"], "__p").withColumnRenamed("active", "active_at_origin"), ["region_id", "active_at_origin"], "left")
    made = []
    for name in baselines:
        for k in horizons:
            rate = F.col(f"__m{k}") if name == "marginal" else F.coalesce(F.col(f"__{name[0]}{k}"), F.col(f"__m{k}"))
            made.append(rate.alias(f"pred_{name}_y_{k}"))
    return joined.select(*rows.columns, *made)


def train_and_predict(matrix: DataFrame, horizons: list[int], split: str = "test", baselines: tuple[str, ...] = NAMES) -> DataFrame:
    """``(region_id, origin_hour, y_{N}, pred_{baseline}_y_{N})`` of a split's rows: :func:`fit_baselines` and :func:`predict_baselines` in
    one pass, for a matrix with one row an origin.

    Training rows are counted by region, hour of the week and flag, and each row of ``split`` stands among these counts as one of its own.
    Rates are sums over the counts of a region, or of one of its hours of the week, so a matrix that is dealt by region is read once
    and shuffled never.
    """
    if unknown := sorted(set(baselines) - set(NAMES)):
        raise ValueError(f"unknown baselines {unknown}")
    if split == "train":
        raise ValueError("training rows cannot be predicted as a split of their own")
    keys = ["region_id", "hour_of_week_kyiv", "active_at_origin"]
    asked = F.when(F.col("split") == split, F.col("origin_hour")).alias("origin_hour")
    labels = [f"y_{k}" for k in horizons]
    counted = matrix.filter(F.col("split").isin("train", split)).groupBy(*keys, asked).agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in labels))
    trained, how = F.col("origin_hour").isNull(), Window.partitionBy("region_id", "hour_of_week_kyiv").orderBy("active_at_origin")
    region = Window.partitionBy("region_id").orderBy("hour_of_week_kyiv", "active_at_origin")  # the same order: sorted once
    whole = lambda window: window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = lambda prefix, rows, window: {f"__{prefix}{c}": F.sum(F.when(rows, F.col(c))).over(whole(window)) for c in ("n", *labels)}
    if "seasonal" in baselines:
        counted = counted.withColumns(sums("s", trained, how))
    of_region = sums("m", trained, region)
    if "persistence" in baselines:
        of_region |= {k: v for flag in (0, 1) for k, v in sums(f"p{flag}", trained & (F.col("active_at_origin") == flag), region).items()}
    summed = counted.withColumns(of_region).filter("origin_hour IS NOT NULL")
    rate = lambda prefix, y: F.col(f"__{prefix}{y}") / F.col(f"__{prefix}n")
    kinds = {
        "marginal": lambda y: rate("m", y),
        "seasonal": lambda y: F.coalesce(rate("s", y), rate("m", y)),
        "persistence": lambda y: F.coalesce(F.when(F.col("active_at_origin") == 1, rate("p1", y)).when(F.col("active_at_origin") == 0, rate("p0", y)), rate("m", y)),
    }
    made = [kinds[b](y).alias(f"pred_{b}_{y}") for b in baselines for y in labels]
    return summed.select("region_id", "origin_hour", *(F.col(y).cast("int").alias(y) for y in labels), *made)


def long_predictions(rows: DataFrame, horizons: list[int], baselines: tuple[str, ...] = NAMES) -> DataFrame:
    """``(region_id, origin_hour, horizon, predictor, y, p)`` from wide predictions.

    Columns are laid into arrays first and picked by number: a structure spelt out for each horizon and baseline becomes a method that
    the JVM leaves uncompiled.
    """
    of = lambda columns: F.array(*columns)
    laid = rows.select("region_id", "origin_hour", of(f"y_{k}" for k in horizons).alias("ys"), *(of(f"pred_{b}_y_{k}" for k in horizons).alias(f"of_{b}") for b in baselines))
    each = laid.select("*", F.posexplode(F.array(*map(F.lit, horizons))).alias("at", "horizon"))
    picked = F.array(*(F.struct(F.lit(b).alias("predictor"), F.get(f"of_{b}", "at").alias("p")) for b in baselines))
    return each.select("region_id", "origin_hour", "horizon", F.get("ys", "at").alias("y"), F.explode(picked).alias("e")).select("region_id", "origin_hour", "horizon", "e.predictor", "y", "e.p")
