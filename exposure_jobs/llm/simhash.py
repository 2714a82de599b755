"""SimHash fingerprints and near-duplicate groups, with pigeonring filtering of the candidates."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from exposure_jobs.llm.common import checkpointed, packed_row, table
from exposure_jobs.llm.components import connected_components, with_least
from exposure_jobs.llm.decontaminate import bounded

BITS = 64
SHINGLE = 3
SEED = 42
MAX_DIFF = 3
#: The ring has eight segments of eight bits. A chain of k consecutive segments may differ in at most k * MAX_DIFF / 8 bits:
#: none in two, one in five, two in seven, three in all eight.
SEGMENTS = 8
#: A bucket with more fingerprints than this is split by longer chains of the ring.
DENSE_BUCKET = 64
_CHUNK = 1 << 16


def simhash64(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A to Z change, only \x20 and \x09-\x0D cut
    if not words:
        return 0
    total = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):  # a chunk at a time, so that a very long text takes no more memory than a short one
        part = words[at : at + _CHUNK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(part)]
        hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return texts.map(simhash64, na_action=None).astype("int64")


def _rotated(bits: Column, by: int) -> Column:
    return bits if by == 0 else F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, BITS - by))


def _bucket_keys() -> list[tuple[int, int, int]]:
    """(rotation in bits, segment left out, mask): what a pair within MAX_DIFF shares at one of the rotations.

    By the pigeonring principle some rotation has no difference in its first two segments and at most one in its first five,
    so one of the three masks that leave out the third, fourth or fifth segment meets the pair.
    """
    wide = BITS // SEGMENTS
    keys = []
    for rotation in range(SEGMENTS):
        for left_out in (2, 3, 4):
            kept = [s for s in range(5) if s != left_out]
            keys.append((rotation * wide, left_out, sum(((1 << wide) - 1) << (BITS - wide * (s + 1)) for s in kept)))
    return keys


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def chain_within_budget(difference: Column) -> Column:
    """Do all chains that start at the first segment keep their budgets? The last of them is the full Hamming check."""
    wide, tests, last = BITS // SEGMENTS, [], None
    for length in range(SEGMENTS, 0, -1):  # of chains with one budget the longest implies the rest
        budget = length * MAX_DIFF // SEGMENTS
        if budget != last:
            tests.append(F.bit_count(F.shiftrightunsigned(difference, BITS - wide * length)) <= budget)
        last = budget
    return reduce(lambda a, b: a & b, reversed(tests))


def near_pairs(prints: DataFrame) -> DataFrame:
    """``prints(fp)``, each once → edges ``(a, b)`` that join all fingerprints that differ in MAX_DIFF bits or fewer.

    In buckets of up to DENSE_BUCKET fingerprints every such pair is an edge. Fuller buckets, as a large group of near copies makes
    them, are split twice: the chain goes on around the ring (:func:`_longer_chains`), then by halves of the segments left over, which
    leaves groups of 4,096 fingerprints at most; there only what hangs together is written (:func:`spanning_forest`).
    """
    rows = F.array(
        *(F.struct(_key(F.col("fp"), n, rotation, mask).alias("k"), _rotated(F.col("fp"), rotation).alias("x"), F.lit(rotation).alias("r"), F.lit(out).alias("out")) for n, (rotation, out, mask) in enumerate(_bucket_keys()))
    )
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # 24 rows come of each
    edges, full = _sparse_edges(spread.select(F.explode(rows).alias("e")).select("e.*"))
    if full is not None:
        more, full = _sparse_edges(_longer_chains(full))
        edges = edges.union(more)
    return edges if full is None else edges.union(_dense_edges(full))


def _sparse_edges(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``keyed(k, x, r, ...)`` → the near pairs of buckets that are not full, and the rows of those that are (None if there are none)."""
    full = checkpointed(keyed.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > DENSE_BUCKET).select("k"), few=True)
    sparse, dense = keyed, None
    if not full.isEmpty():
        full = bounded(full)
        sparse, dense = keyed.join(full, "k", "left_anti"), checkpointed(keyed.join(full, "k", "left_semi"))
    left = sparse.select("k", F.col("x").alias("xa"), "r")
    right = sparse.select("k", F.col("x").alias("xb"))
    pairs = left.join(right, (left.k == right.k) & (F.col("xa") < F.col("xb")) & chain_within_budget(F.col("xa").bitwiseXOR(F.col("xb"))))
    return pairs.select(_rotated_back("xa", "r").alias("a"), _rotated_back("xb", "r").alias("b")), dense


def _segment(number: int) -> Column:
    return F.shiftrightunsigned("x", BITS - 8 * (number + 1)).bitwiseAND(F.lit(255))


def _longer_chains(full: DataFrame) -> DataFrame:
    """Rows of full buckets under keys of one segment more.

    A chain of seven segments may differ in two bits, so of the three that a key leaves open among its first seven (the one left out
    of the first five, the sixth, the seventh) one is equal: it joins the key, and the other two with the eighth stay open in ``rest``.
    """
    left_out = F.when(F.col("out") == 2, _segment(2)).when(F.col("out") == 3, _segment(3)).otherwise(_segment(4))
    three, last, made = [left_out, _segment(5), _segment(6)], _segment(7), []
    for n, held in enumerate(three):
        a, b = three[:n] + three[n + 1 :]
        rest = F.shiftleft(a, 16).bitwiseOR(F.shiftleft(b, 8)).bitwiseOR(last)
        made.append(F.struct(F.xxhash64("k", F.lit(n), held).alias("k"), F.col("x"), F.col("r"), rest.alias("rest")))
    return full.select(F.explode(F.array(*made)).alias("e")).select("e.*")


def _key(fp: Column, number: int, rotation: int, mask: int) -> Column:
    """The kept 32 bits of the rotated fingerprint and the key's number, as one long."""
    kept = F.shiftrightunsigned(_rotated(fp, rotation).bitwiseAND(F.lit(_signed(mask))), BITS - 5 * (BITS // SEGMENTS))
    return kept.bitwiseOR(F.lit(number << (5 * BITS // SEGMENTS)))


def _rotated_back(x: str, r: str) -> Column:
    result = F.col(x)
    for rotation in range(BITS // SEGMENTS, BITS, BITS // SEGMENTS):
        result = F.when(F.col(r) == rotation, _rotated(F.col(x), BITS - rotation)).otherwise(result)
    return result


def _dense_edges(full: DataFrame) -> DataFrame:
    """Edges that join what lies within MAX_DIFF bits, for rows of buckets that are full under the longer keys too.

    Of the six halves of the three open segments at most three differ, so each pair agrees on one of twenty sets of three. Such a
    key leaves twelve bits open: a group has 4,096 different fingerprints at most, however many documents there are.
    """
    masks = [sum(0xF << (4 * s) for s in held) for held in combinations(range(6), 6 - MAX_DIFF)]
    keys = F.array(*(F.xxhash64("k", F.lit(m), F.col("rest").bitwiseAND(F.lit(m))) for m in masks))
    keyed = full.select(_rotated_back("x", "r").alias("fp"), F.explode(keys).alias("k"))
    grouped = keyed.groupBy("k").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return grouped.select(F.explode(_forest("fps")).alias("e")).select("e.a", "e.b").distinct()


@F.pandas_udf(ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())])))
def _forest(lists: pd.Series) -> pd.Series:
    return lists.map(spanning_forest)


def spanning_forest(prints: np.ndarray) -> list[dict]:
    """A spanning forest of the near pairs of one group (4,096 fingerprints at most), breadth first."""
    values = np.unique(np.asarray(prints, np.int64)).view(np.uint64)
    left, edges = np.ones(len(values), bool), []
    while left.any():
        queue = [int(np.flatnonzero(left)[0])]
        left[queue[0]] = False
        while queue:
            at = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(values ^ values[at]) <= MAX_DIFF))
            left[near] = False
            queue.extend(near.tolist())
            edges.extend({"a": int(values[at].view(np.int64)), "b": int(values[n].view(np.int64))} for n in near)
    return edges


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, th, fp)`` of each row, ``th`` being a hash of its text; ``(fp, root, component_id)`` of each fingerprint."""
    prints = checkpointed(docs.select("doc_id", F.xxhash64("text").alias("th"), fingerprint("text").alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(near_pairs(nodes.select("fp")))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return prints, checkpointed(with_least(linked, ["root"], "least_id").select("fp", "root", F.col("least").alias("component_id")), few=True)


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, fp, component_id)``, one row per input row.

    Defined cases: null or blank text has fingerprint zero and links like any other; repeated rows stay; a null doc_id counts
    in no minimum (a group of null ids alone has a null component_id); an empty table gives no rows; other columns are ignored
    whatever their names.
    """
    prints, labelled = _groups(docs)
    return prints.join(labelled, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, in the same columns: that of the least doc_id.

    Defined cases: a null doc_id comes after all others, so a group of null ids alone keeps one of them; of different texts under
    the least id the one with the least hash stays, of repeated rows the one with the least hash of all its columns (maps left
    out); an empty table gives no rows; other columns stay as they are, whatever their names.
    """
    prints, labelled = _groups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "th")).alias("f")
    survivors = prints.join(labelled, "fp").groupBy("root").agg(first).select(F.col("f.doc_id").alias("i"), F.col("f.th").alias("h"))
    times = prints.groupBy(F.col("doc_id").alias("i2"), F.col("th").alias("h2")).agg(F.count("*").alias("times"))
    survivors = checkpointed(survivors.join(times, F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).select("i", "h", "times"), few=True)
    content = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    own = packed_row(docs, id=F.col("doc_id"), th=F.xxhash64("text"), content=content)
    kept = own.join(bounded(survivors), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    if not survivors.filter("times > 1").isEmpty():  # only then do rows have to meet
        order = F.row_number().over(Window.partitionBy("id", "th").orderBy("content"))
        kept = kept.filter("times = 1").select("row").union(kept.filter("times > 1").withColumn("n", order).filter("n = 1").select("row"))
    return kept.select("row.*")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
