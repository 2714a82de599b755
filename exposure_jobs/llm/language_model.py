"""Stupid-backoff scores of documents under the corpus's own n-grams, each document's own occurrences left out.

Counts of all n-grams up to ORDER are too many to send one row each, so documents are dealt into blocks and n-grams travel packed:
1. each block sends its distinct n-grams, as sorted 64-bit hashes with their counts, to the hash partitions of the count table;
2. each partition adds them up and answers every block with the totals of what it asked, in the order asked;
3. the block, joined with its answers, has the counts of every place and sums the scores of its documents.
A frequent n-gram is one entry of each block, so it makes no partition larger than the number of blocks does. A block sends a message
to a partition only if it has an n-gram for it: messages grow with the square of the data while they hold many n-grams, and never
outnumber the blocks' distinct n-grams, which grow in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from exposure_jobs.llm.common import table

ORDER, ALPHA = 3, 0.4
#: An n-gram that no other document has counts as this many at the lowest order.
UNSEEN = 0.5
#: Characters of text that a block should hold, and partitions of the count table for each block.
BLOCK_CHARS, PARTITIONS_PER_BLOCK = 8_000_000, 4
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _STEPS[1]
    h = (h ^ (h >> np.uint64(29))) * _STEPS[2]
    return h ^ (h >> np.uint64(32))


def grams(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many words each text (in UTF-8) has, and by order the hash of the n-gram that ends at each word (0 where the text has none yet)."""
    words = [t.lower().split() for t in texts]
    many = np.fromiter(map(len, words), np.int64, len(words))
    total = int(many.sum())
    single = np.fromiter((xxhash.xxh64_intdigest(w) for ws in words for w in ws), np.uint64, total)
    place = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    found, running = [], np.zeros(total, np.uint64)
    for order in range(1, ORDER + 1):
        before = np.zeros(total, np.uint64)
        before[order - 1 :] = single[: total - order + 1]
        running = running + before * _STEPS[order % 3] * np.uint64(2 * order + 1) if order > 1 else single.copy()
        h = _mixed(running + np.uint64(order))
        h[place < order - 1] = 0
        found.append(h)
    return many, found


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes, no more planes than the largest needs."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


@F.pandas_udf(BinaryType())
def packed_text(texts: pd.Series) -> pd.Series:
    """Texts as they travel to their blocks: compressed one by one, which the shuffle's own codec does less well."""
    codec = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda t: codec.compress((t or "").encode("utf-8", "surrogatepass")))


def _asked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; the block's distinct n-grams, which of them ends at each word by order, and how often each is there."""
    codec = zstandard.ZstdDecompressor()
    many, found = grams([codec.decompress(z) for z in frame["z"]])
    distinct, which, count = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    return many, distinct, which, count


def _bounds(distinct: np.ndarray, partitions: int) -> np.ndarray:
    """Where the hashes of each partition begin among the sorted ``distinct``."""
    edges = np.array([(p << 64) // partitions for p in range(partitions)], dtype=object)
    return np.r_[np.searchsorted(distinct, np.array([int(e) for e in edges], np.uint64)), len(distinct)]


def _ask(partitions: int) -> Callable:
    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, distinct, _, count = _asked(frame)
        at, rows = _bounds(distinct, partitions), []
        for p in range(partitions):
            a, b = at[p], at[p + 1]
            if b > a:
                rows.append((int(key[0]), p, _packed(np.diff(distinct[a:b], prepend=np.uint64(0))), _packed(count[a:b].astype(np.uint64))))
        return pd.DataFrame(rows, columns=["block", "part", "grams", "counts"])

    return ask


def answer(frame: pd.DataFrame) -> pd.DataFrame:
    """One partition of the count table: the blocks' lists are added up and each gets the totals of its own n-grams."""
    lists = [np.cumsum(_unpacked(g), dtype=np.uint64) for g in frame["grams"]]
    distinct, which = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(which, np.concatenate([_unpacked(c) for c in frame["counts"]]).astype(np.float64), len(distinct)).astype(np.uint64)[which]
    ends = np.cumsum([len(x) for x in lists])
    return pd.DataFrame({"block": frame["block"], "part": frame["part"], "totals": [_packed(totals[e - len(x) : e]) for e, x in zip(ends, lists, strict=True)]})


def backoff_scores(counts: list[np.ndarray], place: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The score of each word in millionths of a nat, and the order whose counts gave it.

    ``counts[k - 1]`` has for each word the count of the k-gram that ends there; the context of a k-gram is the (k-1)-gram one word before.
    """
    n = len(place)
    score, used, left, factor = np.zeros(n), np.ones(n, np.int64), np.ones(n, bool), np.ones(n)
    for order in range(ORDER, 1, -1):
        context = np.zeros(n)
        context[1:] = counts[order - 2][:-1]
        able = left & (place >= order - 1)
        hit = able & (counts[order - 1] > 0)
        score[hit] = factor[hit] * counts[order - 1][hit] / context[hit]
        used[hit] = order
        left &= ~hit
        factor[able & ~hit] *= ALPHA
    score[left] = factor[left] * np.maximum(counts[0][left], UNSEEN) / max(1, total)
    return np.rint(1e6 * np.log(score)).astype(np.int64), used


def _score(total: int) -> Callable:
    def score(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        many, distinct, which, _ = _asked(docs)
        totals = np.concatenate([_unpacked(t) for t in answers.sort_values("part")["totals"]]).astype(np.int64) if len(answers) else np.zeros(len(distinct), np.int64)
        doc = np.repeat(np.arange(len(docs)), many)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        others = []
        for k, at in enumerate(which.reshape(ORDER, -1)):  # the totals without what the document itself has
            _, of_doc, in_doc = np.unique(at * len(docs) + doc, return_inverse=True, return_counts=True)
            others.append(np.where(place >= k, totals[at] - in_doc[of_doc], 0))
        micro, used = backoff_scores(others, place, total)
        sums = [np.bincount(doc, used == k, len(docs)).astype(np.int64) for k in range(ORDER, 0, -1)]
        log = np.zeros(len(docs), np.int64)
        np.add.at(log, doc, micro)
        return pd.DataFrame({"doc_id": docs["doc_id"].astype("Int64"), "n_words": many, "n_trigram": sums[0], "n_bigram": sums[1], "n_unigram": sums[2], "log_score_micro": log})

    return score


def score(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, n_words, n_trigram, n_bigram, n_unigram, log_score_micro)``, one row per input row.

    The log score is the sum over words of ln S in millionths of a nat, each word rounded; the three counts say how often each order
    gave it. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Defined cases: null or blank text has no words and score 0;
    each row is a document of its own, so a repeated row is another document to its copy; null ids stay; an empty table gives no
    rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    sizes = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.coalesce(F.sum(words), F.lit(0)).alias("words")).first()
    blocks = max(1, -(-sizes.chars // BLOCK_CHARS))
    partitions = PARTITIONS_PER_BLOCK * blocks
    dealt = docs.select("doc_id", packed_text("text").alias("z"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    asked = dealt.groupBy("block").applyInPandas(_ask(partitions), "block long, part long, grams binary, counts binary")
    answers = asked.groupBy("part").applyInPandas(answer, "block long, part long, totals binary")
    schema = "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, log_score_micro long"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(sizes.words), schema)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, p, w[p] AS g1, CASE WHEN p > 1 THEN w[p - 1] || ' ' || w[p] END AS g2, CASE WHEN p > 2 THEN w[p - 2] || ' ' || w[p - 1] || ' ' || w[p] END AS g3
      FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
n AS (SELECT greatest(count(*), 1)::DOUBLE AS n FROM t),
c1 AS (SELECT r, g1, sum(count(*)) OVER (PARTITION BY g1) - count(*) AS c FROM t GROUP BY r, g1),
c2 AS (SELECT r, g2, sum(count(*)) OVER (PARTITION BY g2) - count(*) AS c FROM t WHERE g2 IS NOT NULL GROUP BY r, g2),
c3 AS (SELECT r, g3, sum(count(*)) OVER (PARTITION BY g3) - count(*) AS c FROM t WHERE g3 IS NOT NULL GROUP BY r, g3),
j AS (SELECT t.r, t.p, c1.c::DOUBLE AS a, coalesce(c2.c, 0)::DOUBLE AS b, coalesce(c3.c, 0)::DOUBLE AS c FROM t
      JOIN c1 ON t.r = c1.r AND t.g1 = c1.g1 LEFT JOIN c2 ON t.r = c2.r AND t.g2 = c2.g2 LEFT JOIN c3 ON t.r = c3.r AND t.g3 = c3.g3),
l AS (SELECT *, lag(a) OVER (PARTITION BY r ORDER BY p) AS pa, lag(b) OVER (PARTITION BY r ORDER BY p) AS pb FROM j),
s AS (SELECT r, CASE WHEN p > 2 AND c > 0 THEN 3 WHEN p > 1 AND b > 0 THEN 2 ELSE 1 END AS o,
      round(1e6 * ln(CASE WHEN p > 2 AND c > 0 THEN c / pb WHEN p > 1 AND b > 0 THEN (CASE WHEN p > 2 THEN 0.4::DOUBLE ELSE 1::DOUBLE END) * b / pa
        ELSE (CASE WHEN p > 2 THEN 0.4::DOUBLE * 0.4::DOUBLE WHEN p = 2 THEN 0.4::DOUBLE ELSE 1::DOUBLE END) * greatest(a, 0.5::DOUBLE) / n END))::BIGINT AS m FROM l, n),
x AS (SELECT r, count(*)::BIGINT AS n_words, count(*) FILTER (o = 3)::BIGINT AS n3, count(*) FILTER (o = 2)::BIGINT AS n2, count(*) FILTER (o = 1)::BIGINT AS n1, sum(m)::BIGINT AS m FROM s GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n3, 0) AS n_trigram, coalesce(n2, 0) AS n_bigram, coalesce(n1, 0) AS n_unigram, coalesce(m, 0) AS log_score_micro FROM d LEFT JOIN x ON d.r = x.r
"""
