"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel of order ORDER counts the character subsequences that two words share, gaps allowed, each weighted by DECAY to the power
of the stretch it takes, and is normalised by the words' own kernels; so ``id.iot`` and ``idioot`` stay near ``idiot``. The machine is
trained on labelled sentences: all sentences of clean texts are clean, those of toxic texts are toxic where a word speaks for it; a
sentence stands for its most toxic word at that point of the training. A document is scored by its three most toxic words.
"""

from __future__ import annotations

import heapq
import re
import sys
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from exposure_jobs.llm.common import crc_remainder, table
from exposure_jobs.llm.compression_quality import class_weights, labelled_sample
from exposure_jobs.llm.linear import fit_logistic, sigmoid

ORDER, DECAY = 4, 0.5
#: Words are compared in stretches of so many characters; a longer word is cut into stretches that overlap by all but STRIDE.
STRETCH, STRIDE = 12, 4
#: Characters are one of 41 signs: a to z, digits as one, everything else (letters with marks, other scripts, marks) by its code, and
#: EDGE, which stands on both sides of words too short for the kernel.
SIGNS, EDGE = 41, "\0"
LANDMARKS, LONGEST_RUN, RIDGE = 128, 8, 1e-4
#: The documented bounds of the fit: at most so many labelled documents of each class, each with all its sentences; so many rounds of
#: choosing what sentences stand for; at most so many words to choose landmarks from, and different words of clean sentences in a round
#: (the most toxic ones first).
SAMPLE_PER_CLASS = 1500
ROUNDS, POOL, CLEAN_WORDS = 3, 1500, 6000
#: A run of ORDER to LONGEST_RUN characters speaks for toxic texts if it stands so many times as often there as in clean texts, as far as
#: the sample bears that out: the logarithm of the ratio, less so many of its standard errors, is compared.
TELLING_RATIO, TELLING_ERRORS = 3.0, 2.5
#: Words of a document that its score reads, and words whose margins a worker remembers.
TOP, REMEMBERED = 3, 1 << 18
#: Texts and words worked on at a time, for memory.
TEXTS, WORDS = 256, 4096
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(text: str | None) -> set[str]:
    """The lower-cased words of a text; a run of three or more single characters also counts as one word."""
    low = (text or "").lower()
    found = set(low.split())
    found.update(run.replace(" ", "").replace("\n", "") for run in _SPACED.findall(low))
    return found


def sentence_words(text: str | None) -> list[list[str]]:
    """The words of each different sentence of a text."""
    return [list(s) for s in dict.fromkeys(tuple(sorted(tokens(s))) for s in _SENTENCE.split(text or "")) if s]


@lru_cache(maxsize=1)
def _sign_table() -> np.ndarray:
    signs = np.empty(0x10000, np.uint8)
    for code in range(0x10000):
        signs[code] = code - 97 if 97 <= code <= 122 else 26 if chr(code).isdigit() else 27 + code % (SIGNS - 28)
    signs[ord(EDGE)] = SIGNS - 1
    return signs


def stretches(words: list[str]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """By length, the stretches of the words as rows of signs, and whose they are. Marks around a word go; inside it they stay
    (the kernel passes over them), and a word that has any counts without them too."""
    texts, owners = [], []
    for n, word in enumerate(words):
        core = word.strip(".,;:!?\"'()[]{}<>*#$%&|-_~`/\\")
        forms = [core]
        if not core.isalnum():
            forms.append("".join(filter(str.isalnum, core)))
        for form in forms:
            if 2 <= len(form) < ORDER:
                form = f"{EDGE}{form}{EDGE}"
            for at in range(0, max(1, len(form) - STRETCH + STRIDE), STRIDE):
                part = form[at : at + STRETCH]
                if len(part) >= ORDER:
                    texts.append(part)
                    owners.append(n)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owners = np.array(owners, np.int64)
    rows, whose = {}, {}
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        codes = np.frombuffer("".join(texts[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows[int(length)] = _sign_table()[np.minimum(codes, 0xFFFF)].reshape(len(at), length)
        whose[int(length)] = owners[at]
    return rows, whose


@lru_cache(maxsize=None)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All choices of ORDER places of a stretch, and DECAY to the power of the stretch each takes."""
    chosen = np.array(list(combinations(range(length), ORDER)), np.int64)
    return chosen, (DECAY ** (chosen[:, -1] - chosen[:, 0] + 1)).astype(np.float32)


def subsequences(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of each row as numbers, and their weights."""
    chosen, weights = _places(signs.shape[1])
    codes = np.zeros((len(signs), len(chosen)), np.int32)
    for k in range(ORDER):
        codes = codes * SIGNS + signs[:, chosen[:, k]]
    return codes, weights


def own_kernel(signs: np.ndarray) -> np.ndarray:
    """K(s, s) of each row, by the kernel's recursion over both prefixes."""
    n = signs.shape[1]
    same = (signs[:, :, None] == signs[:, None, :]).astype(np.float32)
    step = np.tril(DECAY ** (np.arange(n)[:, None] - np.arange(n)[None, :] + 1.0)).astype(np.float32)
    inner = np.ones_like(same)
    for _ in range(ORDER - 1):  # inner[x, y]: what the prefixes before x and y share, each weighted up to its end
        reach = step @ (same * inner) @ step.T
        inner = np.zeros_like(same)
        inner[:, 1:, 1:] = reach[:, :-1, :-1]
    return (same * inner).sum((1, 2)) * DECAY**2


def normalised_profiles(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch number, subsequence, weight, owner of each stretch): sparse feature rows of length one."""
    rows, whose = stretches(words)
    at, stretch, codes, weights, owner = 0, [], [], [], []
    for length, signs in rows.items():
        c, w = subsequences(signs)
        norm = np.sqrt(own_kernel(signs))
        stretch.append(np.repeat(np.arange(at, at + len(signs)), c.shape[1]))
        codes.append(c.ravel())
        weights.append((w[None, :] / norm[:, None]).ravel())
        owner.append(whose[length])
        at += len(signs)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(stretch), np.concatenate(codes), np.concatenate(weights), np.concatenate(owner)) if at else (empty, empty, np.zeros(0), empty)


def kernel_rows(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel of each word with each landmark (a landmark is one stretch); the greatest over a word's stretches."""
    return np.concatenate([_kernel_rows(words[at : at + WORDS], landmarks) for at in range(0, max(1, len(words)), WORDS)])


def _kernel_rows(words: list[str], landmarks: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(landmarks)), np.float64)
    near, c_l, w_l, order = normalised_profiles([m[:STRETCH] for m in landmarks])
    stretch, codes, weights, owner = normalised_profiles(words)
    if not len(owner) or not len(order):
        return out
    own = np.unique(c_l)  # only subsequences that a landmark has can count
    profile = np.zeros((len(own), len(landmarks)), np.float32)
    np.add.at(profile, (np.searchsorted(own, c_l), order[near]), w_l)
    column = np.full(SIGNS**ORDER, -1, np.int32)
    column[own] = np.arange(len(own))
    met = np.flatnonzero(column[codes] >= 0)
    for at in range(0, len(met), 1 << 17):
        part = met[at : at + (1 << 17)]
        begins = np.flatnonzero(np.r_[True, np.diff(stretch[part]) != 0])
        sums = np.add.reduceat(weights[part][:, None] * profile[column[codes[part]]], begins, axis=0)
        if at and stretch[part[0]] == last:
            sums[0] += carry
        last, carry = stretch[part[-1]], sums[-1]
        np.maximum.at(out, owner[stretch[part[begins]]], sums)
    return out


def _stretch_owner(words: list[str]) -> np.ndarray:
    return normalised_profiles(words)[3]


class ToxicWords:
    """The fitted machine, folded into one weight for each subsequence: f(s) = bias + sum over landmarks of alpha K(landmark, s)."""

    def __init__(self, weights: np.ndarray, bias: float, calibration: dict):
        self.weights, self.bias, self.calibration = weights, bias, calibration
        self.known: dict[str, float] = {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The margin of each word; words of one character have the bias, as words that share nothing with a landmark."""
        return np.concatenate([self._word_scores(words[at : at + WORDS]) for at in range(0, max(1, len(words)), WORDS)])

    def _word_scores(self, words: list[str]) -> np.ndarray:
        best = np.zeros(len(words))
        rows, whose = stretches(words)
        for length, signs in rows.items():
            for at in range(0, len(signs), 4096):
                part = signs[at : at + 4096]
                codes, weights = subsequences(part)
                raw = self.weights[codes] @ weights
                up = np.flatnonzero(raw > 0)
                if len(up):
                    np.maximum.at(best, whose[length][at : at + 4096][up], raw[up] / np.sqrt(own_kernel(part[up])))
        return best + self.bias

    def margins(self, bags: list[set[str]]) -> np.ndarray:
        """The TOP greatest margins of each set of words, the bias where there are fewer; words' margins are remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = sorted(set().union(*bags) - self.known.keys())
        self.known.update(zip(new, self.word_scores(new).tolist(), strict=True))
        out = np.full((len(bags), TOP), self.bias)
        for n, bag in enumerate(bags):
            top = heapq.nlargest(TOP, map(self.known.__getitem__, bag))
            out[n, : len(top)] = top
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(margins.reshape(len(margins), -1), self.calibration)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the rows inside the margin; y is +1 or -1."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge * weight.sum())
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        inside = y * (z @ w) < 1
        zi, wi = z[inside], weight[inside][:, None]
        target = np.linalg.solve(zi.T @ (zi * wi) + np.diag(penalty), zi.T @ (y[inside] * weight[inside]))
        if np.allclose(target, w, atol=1e-8):
            break
        w = target
    return w[:-1], float(w[-1])


class Labelled(NamedTuple):
    y: int
    sentences: list[list[str]]


def fit(rows: list, weights: tuple[float, float] = (1.0, 1.0)) -> ToxicWords:
    """A machine from labelled texts ``(y, sentences)``, the sentences as :func:`sentence_words` gives them.

    In each round every clean sentence stands for its most toxic word (so a word weighs by the clean sentences it stands for), every
    sentence of a toxic text that has telling words for the most telling one. The calibration counts a row as ``weights`` of its class.
    """
    y_all = np.array([r.y for r in rows], int)
    standing = np.array(weights)[y_all]
    bags = [set().union(*r.sentences) for r in rows]
    clean = [s for r in rows if r.y == 0 for s in r.sentences]
    toxic = [s for r in rows if r.y == 1 for s in r.sentences]
    if not toxic or not clean:
        return ToxicWords(np.zeros(SIGNS**ORDER, np.float32), 0.0, fit_logistic(np.zeros((len(rows), TOP)), y_all.astype(float), weight=standing))
    telling = _telling([(r.y, sorted(b)) for r, b in zip(rows, bags, strict=True)])
    words = sorted({w for s in clean for w in s} | {w for w, v in telling.items() if v > 0})
    place = {w: n for n, w in enumerate(words)}
    flat, ends = np.array([place[w] for s in clean for w in s]), np.cumsum([0, *map(len, clean)])
    told = [np.array([place[w] for w in s if telling.get(w, 0.0) > 0], int) for s in toxic]
    told = [t for t in told if len(t)]
    values = np.array([telling.get(w, 0.0) for w in words])
    seen = np.zeros(len(words))  # how many clean sentences a word stands for, the greatest number of all rounds
    rng = np.random.default_rng(7)
    best = [t[np.argmax(values[t])] for t in told] or [int(np.argmax(values))]
    positive, many = np.unique(best, return_counts=True)
    scores, machine = values + 1e-6 * rng.random(len(words)), None  # at first any word may stand for a clean sentence
    for _ in range(ROUNDS + 1):
        top = np.maximum.reduceat(scores[flat], ends[:-1])
        first = np.flatnonzero(scores[flat] == np.repeat(top, np.diff(ends)))
        _, once = np.unique(np.searchsorted(ends, first, side="right"), return_index=True)
        seen = np.maximum(seen, np.bincount(flat[first[once]], minlength=len(words)))
        met = np.flatnonzero(seen)
        met = met[np.argsort(-scores[met], kind="stable")]
        half = CLEAN_WORDS // 2
        negative = np.r_[met[:half], rng.permutation(met[half:])[:half]]
        landmarks = _landmarks([words[i] for i in positive], [words[i] for i in negative[: CLEAN_WORDS // 4]], [words[i] for i in negative])
        k = kernel_rows([words[i] for i in [*positive, *negative]], landmarks)
        root = _inverse_root(kernel_rows(landmarks, landmarks))
        share = np.r_[many / many.sum(), seen[negative] / seen[negative].sum()] * (len(positive) + len(negative)) / 2
        w, bias = _svm(k @ root, np.r_[np.ones(len(positive)), -np.ones(len(negative))], share)
        machine = ToxicWords(_folded(landmarks, root @ w), bias, {})
        scores = machine.word_scores(words)
    machine.calibration = fit_logistic(machine.margins(bags), y_all.astype(float), ridge=1e-3, weight=standing)
    machine.known.clear()
    return machine


def _inverse_root(kernel: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(kernel + 1e-6 * np.eye(len(kernel)))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def _runs(word: str) -> set[str]:
    return {word[i : i + n] for n in range(ORDER, LONGEST_RUN + 1) for i in range(len(word) - n + 1)}


def _telling(bags: list) -> dict[str, float]:
    """Words by how far the runs of characters in them speak for toxic texts (the best run of a word counts)."""
    counts = [{}, {}]
    for y, bag in sorted(bags, key=lambda b: -b[0]):
        for run in set().union(*map(_runs, bag)) if bag else ():
            if y or run in counts[1]:
                counts[y][run] = counts[y].get(run, 0) + 1
    n = [max(1, sum(y == k for y, _ in bags)) for k in (0, 1)]
    value = {}
    for run, c in counts[1].items():
        other = counts[0].get(run, 0)
        least = np.log((c + 0.1) / n[1]) - np.log((other + 0.5) / n[0]) - TELLING_ERRORS * (1 / c + 1 / (other + 1)) ** 0.5
        if least > np.log(TELLING_RATIO):
            value[run] = least * c**0.5
    return {w: max((value.get(run, 0.0) for run in _runs(w)), default=0.0) for y, b in bags if y == 1 for w in b}


def _landmarks(positives: list[str], hard: list[str], negatives: list[str]) -> list[str]:
    """Half from the toxic words and a quarter from the clean words most like them, each chosen as far as possible from those
    chosen before; the rest from the other clean words."""
    rng = np.random.default_rng(11)
    chosen: list[str] = []
    for words, many in ((positives, LANDMARKS // 2), (hard, LANDMARKS // 4)):
        pool = words if len(words) <= POOL else [words[i] for i in sorted(rng.choice(len(words), POOL, replace=False))]
        pool = _stems(pool)
        near = np.zeros(len(pool))
        for _ in range(min(len(pool), many)):
            at = int(np.argmin(near))
            chosen.append(pool[at])
            near = np.maximum(near, kernel_rows(pool, [pool[at]])[:, 0])
            near[at] = 2
    rest = _stems(negatives)
    chosen += [rest[i] for i in sorted(rng.choice(len(rest), min(len(rest), LANDMARKS - len(chosen)), replace=False))]
    chosen = list(dict.fromkeys(chosen))
    usable = _stretch_owner(chosen)
    return [chosen[i] for i in sorted(set(usable.tolist()))]


def _stems(words: list[str]) -> list[str]:
    """Words as landmarks: no marks, one stretch, each once, in their order."""
    plain = ("".join(filter(str.isalnum, w))[:STRETCH] for w in words)
    return list(dict.fromkeys(w for w in plain if len(w) >= 2))


def _folded(landmarks: list[str], alpha: np.ndarray) -> np.ndarray:
    """sum over landmarks of alpha times their normalised subsequence weights: the same sum as over kernels, in another order."""
    stretch, codes, weights, owner = normalised_profiles(landmarks)
    dense = np.zeros(SIGNS**ORDER, np.float64)
    np.add.at(dense, codes, weights * alpha[owner[stretch]])
    return dense.astype(np.float32)


def score(docs: DataFrame, machine: ToxicWords) -> DataFrame:
    """``docs`` → ``(doc_id, score)``: null text counts as empty, rows stay as they are, an empty table gives no rows.

    The machine (12 MB whatever the corpus) goes to the executors as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        model = shared.value
        parts = (texts.iloc[at : at + TEXTS] for at in range(0, len(texts), TEXTS))
        made = [model.probabilities(model.margins([tokens(t) for t in part])) for part in parts]
        return pd.Series(np.concatenate(made) if made else np.zeros(0))

    return docs.select("doc_id", scored("text").alias("score"))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(sentence_words, na_action=None)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crc_remainder("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels")
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", SAMPLE_PER_CLASS, out)
    found = sample.select("doc_id", "y", sentences("text").alias("sentences")).orderBy("doc_id").toLocalIterator()  # words of a bounded sample, not texts
    rows = [Labelled(r.y, [list(map(sys.intern, s)) for s in r.sentences]) for r in found]  # each word once
    machine = fit(rows, class_weights(labels, "toxic", SAMPLE_PER_CLASS, out))
    return score(docs, machine).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
