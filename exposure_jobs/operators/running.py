"""Running aggregates over keys of any size: ranges of rows instead of one window for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure_jobs.functions.durable import checkpointed, shuffle_partitions

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}


def _with_carry(kind: str, own: Column, carried: Column) -> Column:
    """An aggregate of a range's own rows together with that of all ranges before it (null: none)."""
    if kind == "max":
        return F.greatest(own, carried)
    if kind == "min":
        return F.least(own, carried)
    whole = F.coalesce(carried, F.lit(0))
    return own + whole if kind == "sum" else own.bitwiseXOR(whole)


def running(rows: DataFrame, keys: list[str], order: list, totals: dict[str, tuple[str, str]], cut_by: list | None = None) -> DataFrame:
    """``rows`` with a column for each of ``totals`` (name → aggregate, column): sum, max, min or xor over the rows of the same keys
    up to the row itself in ``order``.

    Rows are dealt to ranges of (keys, order), written once, and aggregated by key and range. That small table, one row for each key
    and range at most, is summed up before each range and joined back; within a range a window does the rest. So a key may hold any
    share of all rows, and no task gets more than a range. ``order`` should be unique within keys (else ties come in any order);
    ranges are cut by ``cut_by`` (the whole order if not given), whose equal rows stay together. Keys must not be null. ``rows`` is computed twice, for a
    sample and for the ranges: hand in what is written or cheap.
    """
    spark = rows.sparkSession
    cut = rows.repartitionByRange(shuffle_partitions(spark), *keys, *(order if cut_by is None else cut_by)).withColumn("__range", F.spark_partition_id())
    ranges = checkpointed(cut)
    ends = ranges.groupBy("__range", *keys).agg(*(_AGGREGATES[kind](column).alias(f"__{name}") for name, (kind, column) in totals.items()))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__range", *keys, *(_AGGREGATES[kind](f"__{name}").over(earlier).alias(f"__{name}") for name, (kind, _) in totals.items()))
    own = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = ranges.select("*", *(_AGGREGATES[kind](column).over(own).alias(name) for name, (kind, column) in totals.items()))
    joined = here.join(carried, ["__range", *keys])
    summed = {name: _with_carry(kind, F.col(name), F.col(f"__{name}")) for name, (kind, _) in totals.items()}
    return joined.withColumns(summed).select(*rows.columns, *totals)
