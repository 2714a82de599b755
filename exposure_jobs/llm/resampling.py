"""Importance resampling towards a target: hashed word features, counted by sorting packed bucket streams, and a draw by perturbed weights."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure_jobs.llm.common import stored, table
from exposure_jobs.operators.running import running

BUCKETS = 10_000  # as many as uint16 holds, at most
MAX_RUN = 1
PERCENT, MIN_WORDS, SEED = 10, 20, 2024
#: A block of the stream ends at so many features or documents; a longer document is a block of its own.
BLOCK_FEATURES, BLOCK_DOCUMENTS = 1 << 20, 1 << 12
_REMEMBERED = 1 << 17

_LETTERS = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lowered, in UTF-8, where every byte of a character beyond 7F is a word's."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Hasher:
    """Features of a text as bucket numbers; remembers words, not longer runs."""

    def __init__(self, buckets: int = BUCKETS, max_run: int = MAX_RUN):
        if not 0 < buckets <= 1 << 16:
            raise ValueError("a bucket number has 16 bits")
        self.buckets, self.max_run, self.known = buckets, max_run, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        known, buckets = self.known, self.buckets
        if len(known) > _REMEMBERED:
            known.clear()
        for w in {w for w in words if w not in known}:
            known[w] = zlib.crc32(w) % buckets
        parts = [np.fromiter(map(known.__getitem__, words), np.uint16, len(words))]
        for n in range(2, min(self.max_run, len(words)) + 1):
            runs = zip(*(words[k:] for k in range(n)), strict=False)
            parts.append(np.fromiter((zlib.crc32(b" ".join(r)) % buckets for r in runs), np.uint16, len(words) - n + 1))
        return np.concatenate(parts)


def bucket_streams(docs: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """``docs(doc_id, text, ...)`` → blocks ``(ids, words, offsets, stream)``: the packed uint16 buckets of many documents' features one
    after the other, where each document's begin (one offset more than documents), and how many words it has."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{id_type}>, words array<int>, offsets array<long>, stream binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets, max_run)
        ids, words, parts, size = [], [], [], 0

        def block(kind: pa.DataType) -> pa.RecordBatch:
            lengths = [len(p) for p in parts]
            offsets = np.r_[0, np.cumsum(lengths, dtype=np.int64)]
            stream = np.concatenate(parts).astype("<u2").tobytes()
            arrays = [pa.array([ids], pa.list_(kind)), pa.array([words], pa.list_(pa.int32())), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([stream], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["ids", "words", "offsets", "stream"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for i in range(batch.num_rows):
                found = hasher(batch["text"][i].as_py())
                ids.append(batch["doc_id"][i].as_py())
                # runs of 1 to m of n words are n + (n - 1) + ...: the words are kept beside, as their number decides who takes part
                words.append(_n_words(len(found), max_run))
                parts.append(found)
                size += len(found)
                if size >= BLOCK_FEATURES or len(parts) >= BLOCK_DOCUMENTS:
                    yield block(kind)
                    ids, words, parts, size = [], [], [], 0
        if parts:
            yield block(kind)

    return rows.mapInArrow(pack, schema)


def _n_words(features: int, max_run: int) -> int:
    """The number of words that have so many runs of 1 to ``max_run`` of them."""
    whole = max_run * (max_run + 1) // 2  # runs of max_run words
    if features >= whole:
        return (features - whole) // max_run + max_run
    return next(n for n in range(max_run + 1) if n * (n + 1) // 2 == features)


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all blocks: each block is sorted and run-length encoded, a task's runs are added up into one row a bucket,
    then the tasks' rows are summed. What comes to the driver is one number for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch["stream"]:
                ordered = np.sort(np.frombuffer(value.as_buffer(), "<u2"), kind="stable")
                starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[starts]] += np.diff(np.r_[starts, len(ordered)])
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["bucket", "n"])

    found = streams.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in found:
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target than in the source, one added to each count; floors."""
    all_s, all_t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((int(t) + 1.0) * (all_s + n) / ((int(s) + 1.0) * (all_t + n)))) for s, t in zip(source, target, strict=True)], np.int64)


def weighed(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: each block's gains gathered by its stream and added up between offsets."""
    id_type = streams.schema["ids"].dataType.elementType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                offsets = batch["offsets"][i].values.to_numpy()
                values = gain[np.frombuffer(batch["stream"][i].as_buffer(), "<u2")]
                sizes = np.diff(offsets)
                weight, full = np.zeros(len(sizes), np.int64), sizes > 0
                if full.any():  # reduceat takes an empty stretch for its first value, so those are left out
                    weight[full] = np.add.reduceat(values, offsets[:-1][full])
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, batch["words"][i].values.cast(pa.int64()), pa.array(sizes), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return streams.mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")


def gumbel_thousandths(doc_id: Column, seed: int = SEED) -> Column:
    """Noise of the double-exponential kind from the id alone, so that a draw can be repeated: highest perturbed weights are a sample
    without replacement by weight."""
    token = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(token.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> DataFrame:
    """``docs(doc_id, text, ...)`` and ``target(text, ...)`` → ``(doc_id, n_features, weight, score, rank)``, one row per input row.

    Streams are written once and read twice, for the counts and for the weights. Ranks come of ranges of scores (:func:`running`), so
    no task or driver sees all of them.

    Defined cases: null or blank text has no features and weight 0; a null doc_id draws its noise as the empty string and comes last
    of equal scores; repeated rows take part each on its own, in any order; empty tables give no rows, or gains of an empty target;
    other columns are ignored.
    """
    streams = stored(bucket_streams(docs, buckets, max_run), "streams")
    wanted = bucket_counts(bucket_streams(target.select(F.lit(0).alias("doc_id"), "text"), buckets, max_run), buckets)
    rows = weighed(streams, gains(bucket_counts(streams, buckets), wanted))
    rows = stored(rows.withColumn("score", F.col("weight") + gumbel_thousandths(F.col("doc_id"), seed)).withColumn("place", F.monotonically_increasing_id()), "scores")
    able = rows.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place")]
    ranked = running(able.withColumn("one", F.lit(1).cast("long")), [], order, {"rank": ("sum", "one")})
    both = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select("doc_id", "n_features", "weight", "score", "rank")
    rest = rows.filter(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return both.unionByName(rest)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_BYTE_TABLE = "crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b::BIGINT] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b)))"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes, beside ``crc(t)``, the table of its 256 remainders."""
    one = f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode({text}))), {one}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH {_BYTE_TABLE},
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
own AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM docs) GROUP BY ALL),
vocabulary AS (SELECT w FROM own UNION SELECT w FROM goal),
hashed AS (SELECT w, {crc32_sql("w")} % {BUCKETS} AS b FROM vocabulary, crc),
s AS (SELECT b, sum(n)::DOUBLE AS s FROM own JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*)::DOUBLE AS t FROM goal JOIN hashed USING (w) GROUP BY b),
total AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS tt),
gain AS (SELECT h.b, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + {BUCKETS}) / ((coalesce(s, 0) + 1) * (tt + {BUCKETS}))))::BIGINT AS g
         FROM (SELECT DISTINCT b FROM hashed) h LEFT JOIN s ON h.b = s.b LEFT JOIN t ON h.b = t.b, total),
weights AS (SELECT r, sum(n * g)::BIGINT AS weight FROM own JOIN hashed USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT docs.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
           FROM docs LEFT JOIN weights ON docs.r = weights.r),
able AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, k::BIGINT AS rank FROM scored LEFT JOIN (SELECT r, k FROM able WHERE k <= {PERCENT} * n // 100) drawn ON scored.r = drawn.r
"""
