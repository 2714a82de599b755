"""Removal of passages that an earlier document has: confirmed recurring phrases, found by sharded Aho-Corasick automata.

1. Each window of WINDOW words has an anchor, the least hash among its runs of ANCHOR words; equal windows have equal anchors, so
   only windows whose anchor stands in two documents can recur, and only those are hashed and counted. 2. A document names each of its
   windows once, however often it repeats it. A window that two documents have belongs to the one with the least id; neighbouring
   windows of one owner make a phrase, whose text is fetched from the owner.
3. All documents are streamed, a shard at a time, through an automaton compiled from the shard's phrases, which locates every
   occurrence in the text itself; the hashes only proposed them.

Anchors and windows that very many documents share are combined before they are shuffled: an anchor that a shard has twice recurs
without being counted, and a window that a shard has twice belongs, for the later documents, to the shard's earliest one (any earlier
document that has the window will do as an owner). Only one row a shard goes on to where all rows of that anchor or window meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from exposure_jobs.llm.common import ascii_words, table
from exposure_jobs.llm.components import SALTS

WINDOW, ANCHOR = 13, 5
#: Documents of one automaton; its patterns are the phrases that these documents hold, so it is no larger than their texts.
SHARD_DOCS = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def in_shards(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], **columns: str) -> DataFrame:
    """``work`` over the rows of ``df``, SHARD_DOCS of an Arrow batch at a time: only a shard's lists and phrases become Python objects."""
    types = pa.schema([(name, getattr(pa, kind)()) for name, kind in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = (b.slice(at, SHARD_DOCS).to_pandas() for b in batches for at in range(0, b.num_rows, SHARD_DOCS))
        for made in work(shards):
            yield pa.RecordBatch.from_pandas(made, types, preserve_index=False)

    return df.mapInArrow(run, ", ".join(f"{name} {'long' if kind == 'int64' else kind}" for name, kind in columns.items()))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    runs = np.zeros(len(hashes) - length + 1, np.uint64)
    for k in range(length):
        runs = runs * _MULTIPLIER + hashes[k : k + len(runs)]
    runs = (runs ^ (runs >> np.uint64(29))) * _MULTIPLIER
    return runs ^ (runs >> np.uint64(32))


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window of a text, from its words' hashes; empty if it has fewer than WINDOW words."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    span, least, width = WINDOW - ANCHOR + 1, _rolled(hashes, ANCHOR), 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least.view(np.int64)


def anchor_rows(shards: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(doc_id, text)`` → ``(doc_id, anchor, salt)``: salt 0 where the anchor is to be counted, from 1 on, by the document, where it is known to recur."""
    for shard in shards:
        found = [np.unique(window_anchors(_hashes(ascii_words(t)))) for t in shard["text"]]
        anchor, doc_id = np.concatenate(found), np.repeat(shard["doc_id"].to_numpy(np.int64), [len(f) for f in found])
        _, first, which, many = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
        known = many[which] > 1
        one = np.r_[np.flatnonzero(~known), first[many > 1]]
        salt = np.r_[np.zeros(len(one), np.int64), _salts(doc_id[known])]
        yield pd.DataFrame({"doc_id": np.r_[doc_id[one], doc_id[known]], "anchor": np.r_[anchor[one], anchor[known]], "salt": salt})


def _spread(doc_id: np.ndarray) -> np.ndarray:
    h = doc_id.view(np.uint64) * _MULTIPLIER
    return h ^ (h >> np.uint64(32))


def _salts(doc_id: np.ndarray) -> np.ndarray:
    return (1 + _spread(doc_id) % np.uint64(SALTS)).astype(np.int64)


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Texts as they are shuffled, compressed one by one."""
    codec = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda t: codec.compress((t or "").encode("utf-8", "surrogatepass")))


def _words(packed_texts) -> Iterator[list[bytes]]:
    codec = zstandard.ZstdDecompressor()
    return (codec.decompress(z).split() for z in packed_texts)


def named_once(at: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each window of a text, as ``2 * at + cut``, and its hash; ``cut`` bids a phrase end before that place.

    The automaton finds a phrase wherever the text repeats it, but a repeat may be shorter than the phrase. So where a repeated run
    of windows starts or stops, the phrase at its first place is cut: the pieces then lie whole in every repeat.
    """
    if not len(at):
        return at.astype(np.int64), prints
    _, index, inverse = np.unique(prints, return_index=True, return_inverse=True)
    first = at[index[inverse]]
    back = at - first
    starts = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(back) != 0)])
    ends = np.r_[starts[1:], len(at)] - 1
    repeat = back[starts] > 0
    cuts = np.concatenate([first[starts[repeat]], first[ends[repeat]] + 1])
    new = back == 0
    return 2 * at[new].astype(np.int64) + np.isin(at[new], cuts), prints[new]


def candidate_windows(shards: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(doc_id, z, recurring)`` → ``(doc_id, at, h, owner, place)``: each different window whose anchor recurs, its place as in :func:`named_once`.

    Where an earlier document of the shard has the window, that document and the window's place there are given, and ``h`` only
    spreads the rows.
    """
    for shard in shards:
        places, prints, many = [], [], []
        for words, recurring in zip(_words(shard["z"]), shard["recurring"], strict=True):
            hashes = _hashes(words)
            at = np.flatnonzero(np.isin(window_anchors(hashes), np.asarray(recurring, np.int64)))
            at, found = named_once(at, _rolled(hashes, WINDOW)[at] if len(at) else np.zeros(0, np.uint64))
            places.append(at)
            prints.append(found)
            many.append(len(at))
        if sum(many):
            doc_id, at, h = np.repeat(shard["doc_id"].to_numpy(np.int64), many), np.concatenate(places), np.concatenate(prints)
            order = np.lexsort((at, doc_id, h))
            doc_id, at, h = doc_id[order], at[order], h[order]
            new = np.r_[True, h[1:] != h[:-1]]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = doc_id > doc_id[lead]
            known = lambda x: pd.Series(x[lead]).astype("Int64").where(later)  # noqa: B023, E731
            yield pd.DataFrame({"doc_id": doc_id, "at": at, "h": np.where(later, _spread(doc_id), h).view(np.int64), "owner": known(doc_id), "place": known(at)})


def phrase_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(doc_id, found)`` → ``(doc_id, owner, first, n)``: runs of windows that stand side by side in the owner too."""
    for batch in batches:
        rows = []
        for doc_id, found in zip(batch["doc_id"], batch["found"], strict=True):
            at, owner, place = np.array([(f["at"], f["owner"], f["place"]) for f in found], np.int64).reshape(-1, 3).T
            at, cut, place = at >> 1, (at & 1) == 1, place >> 1
            order = np.lexsort((at, at - place, owner))
            at, cut, owner, place = at[order], cut[order], owner[order], place[order]
            cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 1) | (np.diff(owner) != 0) | cut[1:]) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)], strict=True):
                rows.append((doc_id, int(owner[a]), int(place[a]), int(b - a)))
        yield pd.DataFrame(rows, columns=["doc_id", "owner", "first", "n"])


def phrase_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(later, first, n, doc_id and z of the owner)``, in the owners' order → ``(doc_id, owner, phrase)``."""
    last, words = None, []
    for batch in batches:
        phrases = []
        for z, a, n in zip(batch["z"], batch["first"], batch["n"], strict=True):
            if z != last:
                last, words = z, next(_words([z]))
            cut = words[a : a + n + WINDOW - 1]
            phrases.append(b" ".join(cut).decode("utf-8", "surrogatepass") if len(cut) >= WINDOW else None)  # none in another text of the owner's id
        yield pd.DataFrame({"doc_id": batch["later"], "owner": batch["doc_id"], "phrase": phrases}).dropna(subset=["phrase"])


def _one_text_per_id(docs: DataFrame) -> DataFrame:
    """``(doc_id, z)``; ids that are null can neither own nor lose words."""
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", packed("text").alias("z"))


def recurring_phrases(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` → ``(doc_id, phrases)``: for each document the phrases ``(owner, phrase)`` that it shares with an earlier one."""
    texts = _one_text_per_id(docs)
    own = in_shards(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"), anchor_rows, doc_id="int64", anchor="int64", salt="int64")
    same = Window.partitionBy("anchor", "salt")
    shared = own.withColumns({"lo": F.min("doc_id").over(same), "hi": F.max("doc_id").over(same)}).filter("salt > 0 OR lo < hi")
    recurring = shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("recurring"))  # bounded by a document's own length
    windows = in_shards(texts.join(recurring.hint("merge"), "doc_id"), candidate_windows, doc_id="int64", at="int64", h="int64", owner="int64", place="int64")
    equal = Window.partitionBy("h", F.col("owner").isNull()).orderBy("doc_id", "at")
    least = {"owner": F.coalesce("owner", F.first("doc_id").over(equal)), "place": F.coalesce("place", F.first("at").over(equal))}
    later = windows.select("doc_id", "at", *(c.alias(name) for name, c in least.items())).filter(F.col("doc_id") > F.col("owner"))
    found = later.groupBy("doc_id").agg(F.collect_list(F.struct("at", "owner", "place")).alias("found"))
    runs = in_shards(found, phrase_runs, doc_id="int64", owner="int64", first="int64", n="int64")
    asked = runs.select(F.col("doc_id").alias("later"), "owner", "first", "n")
    owners = asked.join(texts, asked.owner == texts.doc_id).select("later", "first", "n", "doc_id", "z")
    fetched = in_shards(owners, phrase_texts, doc_id="int64", owner="int64", phrase="string")
    return fetched.groupBy("doc_id").agg(F.collect_set(F.struct("owner", "phrase")).alias("phrases"))


def compiled(phrases: dict[str, int]) -> ahocorasick.Automaton:
    """An automaton over phrases, each with its words' number and its owner."""
    automaton = ahocorasick.Automaton()
    for phrase, owner in phrases.items():
        automaton.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase) + 1, owner))
    automaton.make_automaton()
    return automaton


def covered(words: list[bytes], doc_id: int, automaton: ahocorasick.Automaton) -> np.ndarray:
    """Which words lie in a phrase that the automaton locates and that an earlier document owns."""
    text = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    begins = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    marks = np.zeros(len(words) + 1, np.int64)
    for end, (many, length, owner) in automaton.iter(text):
        if owner < doc_id:
            first = int(np.searchsorted(begins, end - length))
            marks[first] += 1
            marks[first + many] -= 1
    return np.cumsum(marks[:-1]) > 0


def kept_words(shard: pd.DataFrame) -> Iterator[tuple[list[bytes], int]]:
    """For each row of ``(doc_id, z, phrases)`` the words that stay, and how many there were; a shard's rows share an automaton."""
    phrases: dict[str, int] = {}
    for found in shard["phrases"]:
        for f in found if found is not None else ():
            phrases[f["phrase"]] = min(f["owner"], phrases.get(f["phrase"], f["owner"]))
    automaton = compiled(phrases) if phrases else None
    for doc_id, words in zip(shard["doc_id"], _words(shard["z"]), strict=True):
        if automaton is None or len(words) < WINDOW:
            yield words, len(words)
        else:
            gone = covered(words, int(doc_id), automaton)
            yield [words[i] for i in np.flatnonzero(~gone)], len(words)


def _applied(docs: DataFrame, finish, **columns: str) -> DataFrame:
    texts = _one_text_per_id(docs)
    joined = texts.join(recurring_phrases(docs), "doc_id", "left")
    nameless = docs.filter(F.col("doc_id").isNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), packed("text").alias("z"), F.lit(None).cast("array<struct<owner:bigint,phrase:string>>").alias("phrases"))
    return in_shards(joined, finish, **columns).unionByName(in_shards(nameless, finish, **columns))


def _kept_texts(shards: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for shard in shards:
        done = list(kept_words(shard))
        yield pd.DataFrame({"doc_id": shard["doc_id"].astype("Int64"), "kept": [b" ".join(w).decode("utf-8", "surrogatepass") for w, _ in done], "n_words": [n for _, n in done], "n_removed": [n - len(w) for w, n in done]})


def _digests(shards: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for shard in shards:
        rows = [(n, n - len(w), hashlib.sha256(b" ".join(w)).hexdigest()) for w, n in kept_words(shard)]
        yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"]).assign(doc_id=shard["doc_id"].astype("Int64"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, kept, n_words, n_removed)``, ``kept`` being the words that stay, joined by spaces.

    Defined cases: null or blank text has no words; a null id neither removes nor loses words; rows that share a doc_id are one
    document as owners (each loses what a smaller id has); repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    return _applied(docs.select("doc_id", "text"), _kept_texts, doc_id="int64", kept="string", n_words="int64", n_removed="int64")


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _applied(docs, _digests, doc_id="int64", n_words="int64", n_removed="int64", kept_sha256="string")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
o AS (SELECT win, min(doc_id) AS owner FROM s GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(s.s, s.s + 13)) AS p FROM s JOIN o ON s.win = o.win WHERE o.owner < s.doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
k AS (SELECT p.doc_id, count(*)::BIGINT AS n_kept, string_agg(word, ' ' ORDER BY p.p) AS kept FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.p = r.p GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, len(d.w)::BIGINT - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
