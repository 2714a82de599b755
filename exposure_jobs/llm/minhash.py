"""MinHash near-duplicates: one-permutation sketches with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from exposure_jobs.llm.common import checkpointed, stored, table
from exposure_jobs.llm.components import SALTS, connected_components, with_least
from exposure_jobs.llm.decontaminate import bounded

SHINGLE = 4
#: Link where 100 * shared >= PERCENT * union.
PERCENT = 80
#: One permutation, cut into BINS; ROWS of them make a band. A pair at the threshold misses all 32 bands in about one case of 20 million.
BINS, ROWS = 128, 4
SEED = 13
#: Of each set, for every residue of its hashes, whether it has an even or odd number of them: two sets differ in at least as many shingles
#: as these bits. Up to some 2,000 shingles that rules out nearly all that is not similar.
PARITY_WORDS = 16
_REMEMBERED = 1 << 17

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_PLACES = np.random.default_rng(SEED)
#: For each bin the order in which it looks for another one that is not empty: a permutation of its own, the same for all documents.
_PROBES = np.array([_PLACES.permutation(BINS) for _ in range(BINS)])
_BAND_ODD = _PLACES.integers(1 << 62, 1 << 63, (BINS // ROWS, ROWS + 1), dtype=np.int64).view(np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Texts → sorted distinct 64-bit hashes of their shingles; remembers the hashes of words."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A to Z change, only \x20 and \x09-\x0D cut
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        total = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):  # as Horner does: places count, and so does the number of words
            total = total * _ODD[0] + each[k : len(words) - width + 1 + k] * _ODD[1]
            total ^= total >> np.uint64(29)
        return np.unique(_mixed(total))


def densified(hashes: np.ndarray) -> np.ndarray:
    """The least hash in each of BINS equal ranges; a bin without any takes that of the first bin with one on its own way round."""
    starts = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    full = np.diff(np.r_[starts, len(hashes)]) > 0
    least = hashes[np.minimum(starts, len(hashes) - 1)]
    if full.all():
        return least
    empty = np.flatnonzero(~full)
    ways = _PROBES[empty]
    least[empty] = least[ways[np.arange(len(empty)), full[ways].argmax(1)]]
    return least


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which tells the band and the ROWS values in it."""
    values = _mixed(sketch).reshape(-1, ROWS)
    return _mixed((values * _BAND_ODD[:, :ROWS]).sum(1, dtype=np.uint64) + _BAND_ODD[:, ROWS]).view(np.int64)


_SKETCH = StructType([StructField("n", IntegerType()), StructField("d1", LongType()), StructField("d2", LongType()), StructField("bands", ArrayType(LongType())), StructField("bits", ArrayType(LongType()))])


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    counts = np.bincount((hashes & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


@F.pandas_udf(_SKETCH)
def sketched(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The number of distinct shingles, a 128-bit digest of the set, its band keys and parities (null for no shingles)."""
    shingler = Shingler()
    for series in texts:
        rows = []
        for text in series:
            hashes = shingler(text)
            if len(hashes) == 0:
                rows.append((0, 0, 0, None, None))
                continue
            digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8")
            rows.append((len(hashes), int(digest[0]), int(digest[1]), band_keys(densified(hashes)), parity_bits(hashes)))
        yield pd.DataFrame(rows, columns=["n", "d1", "d2", "bands", "bits"])


@F.pandas_udf(LongType())
def shared_shingles(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How many shingles two whole texts share. Rows of one text mostly come together, so the last of either side are kept."""
    shingler, last = Shingler(), [("", np.zeros(0, np.uint64))] * 2

    def of(side: int, text: str) -> np.ndarray:
        if text != last[side][0]:
            last[side] = (text, shingler(text))
        return last[side][1]

    def shared(a: np.ndarray, b: np.ndarray) -> int:
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0

    for left, right in texts:
        yield pd.Series([shared(of(0, a), of(1, b)) for a, b in zip(left, right, strict=True)], dtype="int64")


def in_groups(rows: DataFrame, keys: list[str], by: str, **wanted: tuple) -> DataFrame:
    """``rows`` with aggregates of their group (name → aggregate function, column), for groups of any size: taken by group and salt (a hash
    of ``by``), then by group, and sent back to the salts that the group has."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "salt").agg(*(f(c).alias(name) for name, (f, c) in wanted.items()))
    whole = parts.groupBy(*keys).agg(*(f(name).alias(name) for name, (f, _) in wanted.items()), F.collect_set("salt").alias("salts"))
    return salted.join(whole.select(*keys, *wanted, F.explode("salts").alias("salt")), [*keys, "salt"]).drop("salt")


def plausible(na: str, nb: str, bits_a: str, bits_b: str) -> Column:
    """False only for pairs that can't reach PERCENT: by their sizes, or because their parities tell of too many shingles of one alone."""
    apart = sum((F.bit_count(F.col(bits_a)[i].bitwiseXOR(F.col(bits_b)[i])) for i in range(PARITY_WORDS)), F.lit(0))
    sizes = 100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)
    return sizes & (apart * (100 + PERCENT) <= (100 - PERCENT) * (F.col(na) + F.col(nb)))


def measured(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` of nodes → ``(a, b, link)`` from the full sets of both texts.

    A node's text is fetched by the two hashes of one text of its class, once; a node in very many pairs meets them in a join that
    adaptive execution splits.
    """
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    keys = checkpointed(nodes.select("node", "n", "t1", "t2").join(asked, "node", "left_semi"), few=True)
    found = docs.select(*_text_keys(), "text").join(bounded(keys), ["t1", "t2"])
    texts = stored(found.groupBy("node").agg(F.first("n").alias("n"), F.first("text").alias("text")), "texts")
    b = texts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("text").alias("tb"))
    a = texts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("text").alias("ta"))
    met = pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", shared_shingles("ta", "tb").alias("shared"))
    link = 100 * F.col("shared") >= PERCENT * (F.col("na") + F.col("nb") - F.col("shared"))
    return checkpointed(met.select("a", "b", link.alias("link")), few=True)


def _text_keys() -> list[Column]:
    return [F.xxhash64(F.lit(seed), "text").alias(name) for seed, name in ((1, "t1"), (2, "t2"))]


def components(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``nodes(node, n, t1, t2, bands, bits)``, one for each different set → ``(node, root)`` of the nodes that link with another one.

    Stars: in each bucket all members are paired with one of them, that with the most neighbours over all its buckets (among copies with
    changes mostly the text they were made from). What :func:`plausible` leaves is measured on full sets. Buckets whose members hang
    together then are done, for pairs inside a component can add nothing. In the others the plausible pairs between components are
    measured too, so every link between members of a bucket counts; members of a bucket's largest component are not paired with one another.
    """
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    spread = in_groups(rows.withColumn("one", F.lit(1).cast("long")), ["bucket"], "node", size=(F.sum, "one"))
    members = checkpointed(spread.filter("size > 1").select("bucket", "node", "size"))
    met = members.groupBy("node").agg(F.sum("size").alias("met"))  # one row for each band of a node at most
    centred = in_groups(members.join(met, "node").withColumn("rank", F.struct("met", "node")), ["bucket"], "node", top=(F.max, "rank"))
    members = checkpointed(centred.select("bucket", "node", F.col("top.node").alias("centre")))
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    stars = members.filter("centre <> node").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    stars = checkpointed(stars.join(side("b"), "b").join(side("a"), "a").filter(plausible("n_a", "n_b", "bits_a", "bits_b")).select("a", "b"), few=True)
    known = measured(stars, nodes, docs)
    roots = checkpointed(connected_components(known.filter("link").select("a", "b")), few=True)
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shares = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most"))
    open_ = rooted.join(shares.filter("roots > 1").select("bucket", F.col("most.root").alias("main")), "bucket")
    open_ = checkpointed(open_.filter("node <> centre").join(nodes.select("node", "n", "bits"), "node"))  # the centre has met all others
    left = open_.filter("root <> main").select("bucket", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "bits", "root")))
    right = open_.select("bucket", "main", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "bits", "root")))
    once = (F.col("root_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    apart = (left.bucket == right.bucket) & (F.col("root_a") != F.col("root_b")) & once & plausible("n_a", "n_b", "bits_a", "bits_b")
    rest = left.join(right, apart).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    rest = checkpointed(rest.join(known, ["a", "b"], "left_anti"), few=True)
    if rest.isEmpty():
        return roots
    more = measured(rest, nodes, docs).filter("link")
    ends = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    lifted = more.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    higher = connected_components(lifted)
    first = roots.union(higher.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti"))
    return first.join(higher.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Equal sets are one node whatever their number. Buckets find pairs, full sets confirm them.

    Defined cases: null or blank text has an empty set, links with nothing and is its own component; fewer words than a shingle are one
    shingle; repeated rows stay; a null doc_id counts in no minimum and is never kept; an empty table gives no rows; other columns are
    ignored whatever their names.
    """
    docs = docs.select("doc_id", "text")
    made = docs.select("doc_id", *_text_keys(), sketched("text").alias("s")).select("doc_id", "t1", "t2", "s.*")
    prints = stored(made, "sketches")
    some = prints.filter("n > 0").groupBy("d1", "d2").agg(F.first(F.struct("n", "t1", "t2", "bands", "bits")).alias("s"), F.min("doc_id").alias("least_id"))
    nodes = checkpointed(some.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "s.*", "least_id"))
    roots = components(nodes, docs)
    linked = nodes.select("node", "d1", "d2", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = with_least(linked, ["root"], "least_id").select("d1", "d2", F.col("least").alias("component_id"))
    full = prints.filter("n > 0").select("doc_id", "n", "d1", "d2").join(labelled, ["d1", "d2"]).select("doc_id", "n", "component_id")
    rows = full.union(prints.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
