"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure_jobs.llm.common import checkpointed


#: A group's rows are dealt over so many salts, by a hash of the value.
SALTS = 64


def with_least(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows(keys, value)`` with the least value of their group as ``least``; no key holds all rows of a group in one task.

    Minima are taken by group and salt, then by group, and go back only to the salts that the group has: at most as many as its rows.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    whole = salted.groupBy(*keys, "salt").agg(F.min(value).alias("m")).groupBy(*keys).agg(F.min("m").alias("least"), F.collect_set("salt").alias("salts"))
    return salted.join(whole.select(*keys, "least", F.explode("salts").alias("salt")), [*keys, "salt"]).drop("salt")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs → ``(node, root)``, root being the least node reachable; nodes without an edge do not appear.

    Each round hangs neighbours under the least node they know, first the larger ones, then the smaller ones. Minima are taken
    and sent back by node and salt (:func:`with_least`), so a hub costs no task all its edges; rounds grow with the logarithm of
    a component's size. Edges are written to the checkpoint folder after each round. Self loops, repeats and either direction
    are fine; an empty edge list gives an empty result.
    """
    edges = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(edges, few=True)
    before = _digest(edges)
    if before[0] == 0:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        edges = checkpointed(_small_star(_large_star(edges)), few=True)
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return row.n, row.h


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = with_least(both, ["a"], "b").filter("b > a")
    return met.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = with_least(down, ["a"], "b")
    moved = met.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(met.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()
