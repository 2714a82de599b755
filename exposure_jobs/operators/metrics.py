"""Proper scores and average precision of probabilities, for any grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposure_jobs.functions.durable import checkpointed, small_side
from exposure_jobs.operators.running import running

EPSILON = 2.220446049250313e-16  # the step of a double at one


def proper_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows(keys, y, p)`` → n_samples, positive_rate, brier_score, log_loss; p is clipped first."""
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    q = F.least(F.greatest(F.col("p"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.avg("y").alias("positive_rate"),
        F.avg((p - F.col("y")) * (p - F.col("y"))).alias("brier_score"),
        F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"),
    )


def _from_the_top(tied: DataFrame, keys: list[str], sums: dict[str, str], spread: bool) -> DataFrame:
    """``tied(keys, p, ...)``, one row a score, with running sums from the highest score down (name → column).

    One window for each key; with ``spread``, for keys that hold very many scores, over ranges of scores (:func:`running`).
    """
    if spread:
        return running(checkpointed(tied), keys, [F.col("p").desc()], {name: ("sum", column) for name, column in sums.items()})
    down = Window.partitionBy(*keys).orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return tied.withColumns({name: F.sum(column).over(down) for name, column in sums.items()})


def average_precision(rows: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """The sum over distinct scores, highest first, of recall gained times precision; NaN where only one class is there.

    Equal scores are counted before the sort, so a group sorts distinct scores only; ``spread`` sorts them in ranges.
    """
    tied = rows.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    ran = _from_the_top(tied, keys, {"seen": "n", "found": "hits"}, spread)
    total = ran.groupBy(*keys).agg(F.sum(F.col("hits") * F.col("found") / F.col("seen")).alias("s"), F.sum("hits").alias("pos"), F.sum("n").alias("n"))
    both = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    return total.select(*keys, F.when(both, F.col("s") / F.when(both, F.col("pos"))).otherwise(F.lit(float("nan"))).alias("pr_auc"))


def evaluate(rows: DataFrame, keys: list[str] | None = None, spread: bool = False) -> DataFrame:
    """All metrics by region, horizon and predictor in one pass: equal scores are counted once, and scores and precision come from the
    counts; ``spread`` sorts a key's scores in ranges."""
    keys = ["region_id", "horizon", "predictor"] if keys is None else keys
    tied = rows.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    ran = _from_the_top(tied, keys, {"seen": "n", "found": "hits"}, spread)
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))
    q = F.least(F.greatest(F.col("p"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    misses = F.col("n") - F.col("hits")
    total = ran.groupBy(*keys).agg(
        F.sum("n").alias("n_samples"),
        F.sum("hits").alias("__hits"),
        F.sum(F.col("hits") * (1 - p) * (1 - p) + misses * p * p).alias("__brier"),
        F.sum(-F.col("hits") * F.log(q) - misses * F.log(1 - q)).alias("__log"),
        F.sum(F.col("hits") * F.col("found") / F.col("seen")).alias("__ap"),
    )
    n, hits = F.col("n_samples"), F.col("__hits")
    both = (hits > 0) & (hits < n)
    return total.select(
        *keys,
        "n_samples",
        (hits / n).alias("positive_rate"),
        (F.col("__brier") / n).alias("brier_score"),
        (F.col("__log") / n).alias("log_loss"),
        F.when(both, F.col("__ap") / F.when(both, hits)).otherwise(F.lit(float("nan"))).alias("pr_auc"),
    )


def brier_uplift(scores: DataFrame, model: str = "model") -> DataFrame:
    """For each other predictor, its Brier score less the model's."""
    keys = [c for c in scores.columns if c in ("region_id", "horizon", "era")]
    own = F.max(F.when(F.col("predictor") == model, F.col("brier_score"))).over(Window.partitionBy(*keys))
    beside = scores.withColumn("model_brier", own).filter((F.col("predictor") != model) & F.col("model_brier").isNotNull())
    return beside.select(*keys, "predictor", (F.col("brier_score") - F.col("model_brier")).alias("brier_uplift"))


def reliability(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    bin_of = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    return bins.groupBy(*keys).agg((F.sum(F.abs(F.col("mean_p") - F.col("rate")) * F.col("n")) / F.sum("n")).alias("ece"))


def false_alarm_threshold(rows: DataFrame, keys: list[str], rate: float, spread: bool = False) -> DataFrame:
    """The least score to alert at with a share of false alarms among negatives of at most ``rate``; null where none qualifies.
    ``spread`` sorts a key's scores in ranges."""
    tied = rows.groupBy(*keys, "p").agg(F.sum(1 - F.col("y")).alias("neg"), F.sum("y").alias("pos"))
    ran = _from_the_top(tied, keys, {"false": "neg", "hit": "pos"}, spread)
    if spread:
        ran = ran.join(small_side(tied.groupBy(*keys).agg(F.sum("neg").alias("negs"), F.sum("pos").alias("poss"))), keys)
    else:
        whole = Window.partitionBy(*keys)
        ran = ran.withColumn("negs", F.sum("neg").over(whole)).withColumn("poss", F.sum("pos").over(whole))
    fine = F.col("false") <= rate * F.col("negs")
    return ran.groupBy(*keys).agg(F.min(F.when(fine, F.col("p"))).alias("threshold"), F.max(F.when(fine & (F.col("poss") > 0), F.col("hit") / F.when(F.col("poss") > 0, F.col("poss")))).alias("recall"))
