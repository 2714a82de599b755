"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure_jobs.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: New words a worker remembers before it drops those that it last met before the last such turn; it holds twice as many at most.
REMEMBERED = 75_000
#: Characters of text whose new words are merged together, and the bytes of a word up to which many are merged at once.
SLICE_CHARS, TOGETHER = 1 << 20, 64
_NONE = 1 << 62
_ID_BITS = 20
_ABSENT = (1 << _ID_BITS) - 1
#: White space as the vocabulary's own rules have it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def merged(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """``symbols`` after all merges, the leftmost pair of the lowest rank first.

    Leaf i holds what pair (i, next of i) becomes, ``rank << 20 | new id``, so the root holds the lowest rank there is. One merge
    changes three leaves; each change climbs only as far as a minimum changes. ``merges`` maps ``left << 20 | right`` to such a value.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    get = merges.get
    for i in range(n - 1):
        tree[size + i] = get(symbols[i] << _ID_BITS | symbols[i + 1], _NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    symbols, after, before = [*symbols, 0], list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) != _NONE:
        at = 1
        while at < size:
            at *= 2
            if tree[at] != best:
                at += 1
        i = at - size
        j = after[i]
        k = after[i] = after[j]
        symbols[i] = best & ((1 << _ID_BITS) - 1)
        symbols[j] = -1
        changes = [(j, _NONE), (i, get(symbols[i] << _ID_BITS | symbols[k], _NONE) if k < n else _NONE)]
        if k < n:
            before[k] = i
        if (h := before[i]) >= 0:
            changes.append((h, get(symbols[h] << _ID_BITS | symbols[i], _NONE)))
        for leaf, value in changes:
            at = size + leaf
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a <= b else b
                if tree[at] == low:
                    break
                tree[at] = low
    return [s for s in symbols[:n] if s >= 0]


def merged_together(words: list[bytes], first: np.ndarray, last: np.ndarray, lookup) -> list[bytes]:
    """The ids of many words of 2 to TOGETHER bytes, packed as little-endian 32-bit numbers.

    The trees of all words stand side by side in one table, of one size for each call: in each turn every word that still has a
    mergeable pair takes the one at its root, changes its three leaves and the nodes above them, and drops out when its root is empty.
    """
    n = np.fromiter(map(len, words), np.int64, len(words))
    size = 1 << int(n.max() - 1).bit_length()
    place = np.arange(size + 1)
    data = np.frombuffer(b"".join(w.ljust(size + 1, b"\0") for w in words), np.uint8).reshape(len(words), size + 1)
    symbols = np.where(place < n[:, None] - 1, first[data], last[data])
    symbols[place >= n[:, None]] = _ABSENT
    after = np.broadcast_to(place + 1, symbols.shape).astype(np.int16)
    before = np.broadcast_to(place - 1, symbols.shape).astype(np.int16)
    tree = np.full((len(words), 2 * size), _NONE, np.int64)
    tree[:, size:] = lookup(symbols[:, :-1] << _ID_BITS | symbols[:, 1:])
    for at in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * at], tree[:, 2 * at + 1], out=tree[:, at])
    rows = np.arange(len(words))
    while len(rows := rows[tree[rows, 1] != _NONE]):
        best, at = tree[rows, 1], np.ones(len(rows), np.int64)
        while at[0] < size:
            at *= 2
            at += tree[rows, at] != best
        i = at - size
        j = after[rows, i].astype(np.int64)
        k = after[rows, j].astype(np.int64)
        h = before[rows, i].astype(np.int64)
        symbol = best & ((1 << _ID_BITS) - 1)
        symbols[rows, i], symbols[rows, j] = symbol, -1
        after[rows, i], before[rows, k] = k, i
        tree[rows, size + j] = _NONE
        tree[rows, size + i] = lookup(symbol << _ID_BITS | symbols[rows, k])
        back = np.flatnonzero(h >= 0)
        tree[rows[back], size + h[back]] = lookup(symbols[rows[back], h[back]] << _ID_BITS | symbol[back])
        at, mine = size + np.stack([i, j, np.where(h >= 0, h, i)], 1), rows[:, None]
        while at[0, 0] > 1:
            at >>= 1
            tree[mine, at] = np.minimum(tree[mine, 2 * at], tree[mine, 2 * at + 1])
    kept = (symbols >= 0) & (symbols != _ABSENT)
    packed = symbols[kept].astype("<u4").tobytes()
    ends = (4 * np.cumsum(kept.sum(1))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _byte_letters() -> list[str]:
    """The printable stand-in for each byte: itself where it is printable, else the next free letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary file: its special strings, its cutting into words, its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: s for s, i in {**self.vocabulary, **self.special}.items()}
        pairs = (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])
        ids = self.vocabulary
        self.merges = {ids[a] << _ID_BITS | ids[b]: rank << _ID_BITS | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = _byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + self.end] for c in letters]
        cut = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.cut = regex.compile(cut)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._first, self._last = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self._pairs = np.array(sorted(self.merges), np.int64)
        self._merge_of = np.array([self.merges[p] for p in self._pairs.tolist()], np.int64)

    def _lookup(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._pairs, pairs), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pairs, self._merge_of[at], _NONE)

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of new words, by the sizes of their trees."""
        sizes: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            size = 0 if len(data) > TOGETHER else len(data) if len(data) == 1 else 1 << (len(data) - 1).bit_length()
            names, bodies = sizes.setdefault(size, ([], []))
            names.append(word)
            bodies.append(data)
        for size, (names, bodies) in sizes.items():
            if size == 1:
                self.known.update((w, self.last[b[0]].to_bytes(4, "little")) for w, b in zip(names, bodies, strict=True))
            elif size:
                self.known.update(zip(names, merged_together(bodies, self._first, self._last, self._lookup), strict=True))
            else:
                for word, data in zip(names, bodies, strict=True):
                    ids = merged([*(self.inner[b] for b in data[:-1]), self.last[data[-1]]], self.merges)
                    self.known[word] = np.array(ids, "<u4").tobytes()

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text; of a long one, some at a time."""
        if len(text) <= SLICE_CHARS:
            yield self.cut.findall(text)
            return
        found = (m.group() for m in self.cut.finditer(text))
        while some := list(islice(found, SLICE_CHARS // 8)):
            yield some

    def _pieces(self, text: str | None) -> Iterator[bytes | list[str]]:
        """A text as the ids of special strings and lists of words."""
        for n, part in enumerate(self.specials.split(text or "")):
            if n % 2:
                yield self.special[part].to_bytes(4, "little")
            else:  # white space only separates words; a capital sigma becomes the plain small one wherever it stands
                yield from self._words(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())

    def encoded(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, little-endian unsigned 32-bit; new words are merged for a slice of the texts at once."""
        waiting, chars, done = [], 0, []
        for text in texts:
            done = []
            for piece in self._pieces(text):
                done.append(piece)
                chars += 4 if isinstance(piece, bytes) else 8 * len(piece)
                if chars > SLICE_CHARS:
                    yield from self._finished(waiting)
                    done, waiting, chars = [b"".join(self._finished([done]))], [], 0
            waiting.append(done)
        yield from self._finished(waiting)

    def _finished(self, texts: list[list[bytes | list[str]]]) -> Iterator[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = set().union(*(p for pieces in texts for p in pieces if isinstance(p, list))) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self._learn(sorted(new - again))
        for pieces in texts:
            yield b"".join(p if isinstance(p, bytes) else b"".join(map(self.known.__getitem__, p)) for p in pieces)

    def decoded(self, ids: bytes) -> str:
        """The tokens of packed ids with a space between."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode_decode(self, text: str | None) -> tuple[bytes, str]:
        """The packed ids of a text, and the decoded text."""
        ids = next(self.encoded([text]))
        return ids, self.decoded(ids)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encoded_column(text: str | Column, path: str | None = None) -> Column:
    """The struct ``(ids array<int>, decoded string)`` of a text column; ``path`` is the vocabulary's on the executors, by default the
    installed public file. Null text counts as empty (no ids, empty decoded text)."""

    @F.pandas_udf("ids array<int>, decoded string")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        bpe = _vocabulary(path)
        done = list(bpe.encoded(texts))
        return pd.DataFrame({"ids": [np.frombuffer(ids, "<i4") for ids in done], "decoded": list(map(bpe.decoded, done))})

    return encoded(text)


def checked_column(text: str | Column, path: str | None = None) -> Column:
    """As :func:`encoded_column`, but of the decoded text only its digest leaves the worker: ``(ids array<int>, decoded_sha256 string)``."""

    @F.pandas_udf("ids array<int>, decoded_sha256 string")
    def checked(texts: pd.Series) -> pd.DataFrame:
        bpe, rows, sums = _vocabulary(path), [], []
        for ids in bpe.encoded(texts):
            rows.append(np.frombuffer(ids, "<i4"))
            sums.append(_sha256(bpe.decoded(ids)))
        return pd.DataFrame({"ids": rows, "decoded_sha256": sums})

    return checked(text)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, ids, decoded)``: the ids, and the text they decode to.

    Rows stay as they are, an empty table gives no rows, other columns are ignored.
    """
    return docs.select("doc_id", encoded_column("text", path).alias("e")).select("doc_id", "e.*")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As :func:`encode`, but only counts and digests leave the worker."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(texts: pd.Series) -> pd.DataFrame:
        bpe = _vocabulary(path)
        rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), _sha256(bpe.decoded(ids))) for ids in bpe.encoded(texts)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digested("text").alias("e")).select("doc_id", "e.*")


def _vocabulary(path: str | None) -> WordBpe:
    import public_tokenizers

    return load(path or public_tokenizers.path(VOCABULARY))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
