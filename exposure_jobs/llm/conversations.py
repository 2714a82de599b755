"""Logged conversations: snapshots that a longer conversation continues are collapsed, the rest are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure_jobs.llm.common import checkpointed, table


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` → ``(conv_id, k, n, h1, h2)``: a rolling 128-bit hash of each conversation's first k of n turns.

    A turn's hash covers its place, so the xor of the first k tells their sequence; it rolls on in one window, without gathering turns.
    """
    once = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    content = [F.col("k"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = once.withColumn("k", F.row_number().over(order)).select("conv_id", "k", *(F.xxhash64(F.lit(seed), *content).alias(name) for seed, name in ((1, "h1"), (2, "h2"))))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select("conv_id", "k", F.count("*").over(Window.partitionBy("conv_id")).alias("n"), *(F.bit_xor(h).over(upto).alias(h) for h in ("h1", "h2")))


def maximal(turns: DataFrame) -> DataFrame:
    """``(conv_id)`` of conversations that no other one continues; of equal conversations the one with the least id.

    Prefixes are counted into one row each before anything is joined, so a prefix that very many conversations share is one row on
    either side of the anti-join.
    """
    prefixes = checkpointed(turn_prefixes(turns))
    each = prefixes.groupBy("h1", "h2", "k").agg(F.max("n").alias("longest"), F.min(F.when(F.col("k") == F.col("n"), F.col("conv_id"))).alias("first"))
    ends, continued = each.filter(F.col("first").isNotNull()), each.filter(F.col("longest") > F.col("k"))
    return ends.join(continued, ["h1", "h2", "k"], "left_anti").select(F.col("first").alias("conv_id"))


def rendered(turns: DataFrame) -> DataFrame:
    """The maximal conversations as text: ``(conv_id, n_turns, text)``, each turn as ``<|role|>`` and its text on lines of their own.

    Defined cases: turns are ordered by number, then role and text, nulls first; repeated rows count once; rows without a conv_id
    are left out; a null role is rendered as ``unknown``, a null text as nothing; an empty table gives no rows; other columns are ignored.
    """
    kept = turns.select("conv_id", "turn", "role", "text").join(maximal(turns), "conv_id", "left_semi")
    whole = kept.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("t"))  # one conversation, as it is rendered
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))
    return whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.concat_ws("", F.transform("t", line)).alias("text"))


def op6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rendered(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP6_SQL = r"""
WITH o AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM o),
l AS (SELECT *, sha256(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')) AS h FROM t),
p AS (SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n, sha256(string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)) AS h FROM l),
g AS (SELECT h, max(n) AS longest, min(conv_id) FILTER (k = n) AS first FROM p GROUP BY h),
m AS (SELECT p.conv_id FROM p JOIN g ON p.h = g.h WHERE p.k = p.n AND g.longest = p.n AND g.first = p.conv_id),
r AS (SELECT t.conv_id, count(*)::BIGINT AS n_turns, string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY k) AS text
      FROM t SEMI JOIN m ON t.conv_id = m.conv_id GROUP BY t.conv_id)
SELECT conv_id, n_turns, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM r
"""
