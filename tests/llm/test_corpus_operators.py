"""Small tables with nulls, blanks, ties, repeats and clashing columns, against brute force written here."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from exposure_jobs.llm import bpe, compression_quality, conversations, decontaminate, language_model, linear, quality_rules, repeated_phrases, sanitise, simhash, toxicity
from exposure_jobs.llm.components import connected_components

SCHEMA = "doc_id long, text string, k string, th string, h long, n_words string"
CORE = "doc_id long, text string"


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("aeioustnrlé") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def sample_texts(seed=3):
    rng, words = random.Random(seed), vocabulary(seed)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    texts += [texts[0], texts[1] + " Tail end", texts[2].upper(), "x " * 3000, "\t\n", "", None, "one", "one two", texts[5] + "\n" + texts[6]]
    shared = " ".join(rng.choice(words) for _ in range(60))
    return texts + [f"{rng.choice(words)} {shared} {rng.choice(words)}" for _ in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", "b", 1, "c") for i, t in enumerate(sample_texts())]
    rows += [rows[3], (None, "a null id with some words in it", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


# --- 1


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_match_brute_force(docs):
    rows = rows_of(docs)
    prints = [plain_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3:
            a, b = part[i], part[j]
            part = [a if p == b else p for p in part]
    want = sorted((str(d), f"{f:016x}", min(rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None)) for (d, _), f, p in zip(rows, prints, part) if any(rows[k][0] is not None for k in range(len(rows)) if part[k] == p))
    found = simhash.near_duplicate_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id").collect()
    assert sorted((str(r.doc_id), r.f, r.component_id) for r in found if r.component_id is not None) == want
    assert len(found) == len(rows)


def test_dense_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "DENSE_BUCKET", 4)
    edges = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    part = {p: p for p in signed}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
        part[root(a)] = root(b)
    for a, b in combinations(signed, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
            assert root(a) == root(b)


def test_components_of_a_long_chain_and_none(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 300), (7, 7)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(101), 0), 300: 300, 400: 300, 500: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_per_group(docs):
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicate_groups(docs).collect()
    alone = sum(r.component_id is None for r in groups)
    assert alone == 1  # the null id, which no other text resembles
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(r.doc_id) for r in groups if r.doc_id is not None and r.doc_id == r.component_id and r.doc_id != 3] + ["3", "None"])


# --- 2


def test_backoff_scores_match_definition(docs, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_CHARS", 2000)
    rows = rows_of(docs)
    words = [re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t)) for _, t in rows]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    count = [{}, {}, {}, {}]
    for w in words:
        for n in (1, 2, 3):
            for g in grams(w, n):
                count[n][g] = count[n].get(g, 0) + 1
    total = sum(map(len, words))

    def score(w):
        others = lambda g: count[len(g)][g] - grams(w, len(g)).count(g)
        out = 0
        for i in range(len(w)):
            n, factor = min(3, i + 1), 1.0
            while n > 1 and others(tuple(w[i - n + 1 : i + 1])) == 0:
                n, factor = n - 1, factor * 0.4
            g = tuple(w[i - n + 1 : i + 1])
            s = factor * (others(g) / others(g[:-1]) if n > 1 else max(others(g), 0.5) / total)
            out += round(1e6 * float(np.log(s)))
        return out

    found = sorted((str(r.doc_id), r.n_words, r.log_score_micro) for r in language_model.score(docs).collect())
    assert found == sorted((str(d), len(w), score(w)) for (d, _), w in zip(rows, words))


# --- 3


@pytest.mark.parametrize("shard", [1, 7, 256])
def test_repeated_phrases_match_brute_force(docs, monkeypatch, shard):
    """With shards of one document nothing is combined before the shuffle; larger ones name owners of their own."""
    monkeypatch.setattr(repeated_phrases, "SHARD_DOCS", shard)
    rows = rows_of(docs)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    windows = [[tuple(w[i : i + 13]) for i in range(len(w) - 12)] for w in words]
    owner = {}
    for (d, _), ws in zip(rows, windows):
        for w in ws:
            if d is not None:
                owner[w] = min(d, owner.get(w, d))
    want = []
    for (d, _), w, ws in zip(rows, words, windows):
        gone = {j for i, x in enumerate(ws) if d is not None and owner[x] < d for j in range(i, i + 13)}
        want.append((str(d), " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    found = [(str(r.doc_id), r.kept, r.n_words, r.n_removed) for r in repeated_phrases.deduplicated(docs).collect()]
    assert sorted(found) == sorted(want)
    assert any(n for *_, n in want)


def test_one_row_a_shard_meets_the_others():
    """A passage of all documents leaves a shard once to be counted, and once more for each document, spread by salts."""
    text = " ".join(f"w{n}" for n in range(13))
    shard = pd.DataFrame({"doc_id": range(200), "text": [text] * 200})
    rows = next(repeated_phrases.anchor_rows(iter([shard])))
    assert (rows["salt"] == 0).sum() == 1 and rows["salt"].nunique() > 30 and set(rows.loc[rows["salt"] > 0, "doc_id"]) == set(range(200))
    z = repeated_phrases.packed.func(shard["text"])
    made = next(repeated_phrases.candidate_windows(iter([shard.assign(z=z, recurring=[[rows["anchor"][0]]] * 200)])))
    assert made["owner"].isna().sum() == 1 and set(made["owner"].dropna()) == {0} and made["h"].nunique() == 200


# --- 4


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def test_repeats_within_a_document_are_named_once(spark):
    """Runs that a document repeats in part, in longer and in periodic form, against the definition."""
    rng, made = random.Random(5), []
    base = [f"w{n}" for n in range(60)]
    for doc_id in range(60):
        words = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randrange(0, 46)
            piece = base[a : a + rng.randint(5, 40)] if rng.random() < 0.7 else ["a", "b"] * rng.randint(1, 30)
            words += piece + [f"x{rng.randrange(3)}"] * rng.randint(0, 2)
        made.append((doc_id, " ".join(words)))
    first: dict = {}
    for doc_id, text in made:
        w = text.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), doc_id)
    expected = {}
    for doc_id, text in made:
        w = text.split()
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < doc_id for q in range(p, p + 13)}
        expected[doc_id] = " ".join(v for q, v in enumerate(w) if q not in gone)
    found = repeated_phrases.deduplicated(spark.createDataFrame(made, "doc_id long, text string"))
    assert {r.doc_id: r.kept for r in found.collect()} == expected
    at, prints = repeated_phrases.named_once(np.arange(1000), np.tile([7, 9], 500).astype(np.uint64))
    assert at.tolist() == [1, 2] and prints.tolist() == [7, 9]


def test_contamination_matches_brute_force(spark, docs):
    texts = sample_texts()
    bench = [" ".join(texts[4].split()[3:25]), "One TWO", "one", None, "", "nothing of this stands anywhere at all in here", texts[-1], " ".join(texts[7].split()[:9])]
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    want = []
    for d, t in rows_of(docs):
        w, hit, names = token(t), set(), []
        for i, b in enumerate(bench):
            x = token(b)
            for win in [x[s : s + 10] for s in range(max(1, len(x) - 9))] if x else []:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        names.append(str(i))
        want.append((str(d), len(w), len(hit), sorted(set(names))))
    found = [(str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items(spark, bench)).collect()]
    assert sorted(found) == sorted(want)
    clean = decontaminate.drop_contaminated(docs, items(spark, bench))
    assert clean.columns == docs.columns and clean.count() == sum(not n for _, _, n, _ in want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red fox a b c blue owl"), (2, "red " + "z " * 50 + "blue"), (3, "blue red")], CORE)
    found = {(r.doc_id, r.width) for r in decontaminate.proximity_matches(docs, items(spark, ["red blue"]), span=10).collect()}
    assert found == {(1, 6), (3, 2)}


# --- 5 and 10


def labelled(seed, n):
    rng, words = random.Random(seed), vocabulary(9)
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        if y := i % 3 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["blockhead", "nincompoop", "scoundrel"])
        rows.append((i, " ".join(w), int(y)))
    return rows


def test_string_kernel_matches_definition():
    def kernel(a, b):
        signs = toxicity._sign_table()
        total = 0.0
        for i in combinations(range(len(a)), 4):
            for j in combinations(range(len(b)), 4):
                if all(signs[ord(a[x])] == signs[ord(b[y])] for x, y in zip(i, j)):
                    total += toxicity.DECAY ** (i[-1] - i[0] + j[-1] - j[0] + 2)
        return total

    for a, b in (("idiot", "idioot"), ("banana", "bananas"), ("stupid", "stxupid"), ("abcd", "wxyz")):
        assert toxicity.kernel_rows([a], [b])[0, 0] == pytest.approx(kernel(a, b) / np.sqrt(kernel(a, a) * kernel(b, b)), abs=1e-5)


def test_toxicity_learns_and_tolerates_insertions(spark):
    from collections import namedtuple

    row = namedtuple("row", "doc_id y sentences")
    machine = toxicity.fit([row(i, y, toxicity.sentence_words(t)) for i, t, y in labelled(1, 300)])
    held = labelled(2, 150)
    docs = spark.createDataFrame([(i, t) for i, t, _ in held] + [(1000, None), (1001, ""), (1002, "you b.l.o.c.k.h.e.a.d")], CORE)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(y) for i, _, y in held]) >= 0.95
    assert scores[1000] == scores[1001] < 0.5 < scores[1002]
    assert toxicity.score(docs.limit(0), machine).count() == 0
    nothing_learnt = toxicity.fit([])
    assert 0 <= nothing_learnt.probabilities(nothing_learnt.margins([{"word"}]))[0] <= 1


def calibrations(spark, tmp_path, monkeypatch, module, query, label, texts, patched):
    """The calibration that a query fits on 1,400 labels of 6 to 1, all of them and at most 60 of each class."""
    rare = label == "toxic"
    ys = [int((i % 7 == 0) == rare) for i in range(1400)]
    spark.createDataFrame([(i, texts(i, y)) for i, y in enumerate(ys)], CORE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ys)), f"doc_id long, {label} int").write.parquet(f"{tmp_path}/labels.parquet")
    rng = np.random.default_rng(2)
    drawn = [float(rng.normal(y)) for y in ys]
    made = []
    monkeypatch.setattr(*patched(drawn))
    monkeypatch.setattr(module, "score", lambda docs, model: made.append(model) or docs.select("doc_id", F.lit(0.0).alias("score")))
    for cap in (100_000, 60):
        monkeypatch.setattr(module, "SAMPLE_PER_CLASS", cap)
        query(spark, str(tmp_path))
    return made


def logit(p):
    return float(np.log(p / (1 - p)))


def test_toxicity_scores_mean_the_same_under_a_small_cap(spark, tmp_path, monkeypatch):
    words = vocabulary(6)
    texts = lambda i, y: f"{i} {' '.join(random.Random(i).choices(words, k=12))}{' blockhead' * y}"
    number = lambda bag: next(int(w) for w in bag if w.isdigit())
    patched = lambda drawn: (toxicity.ToxicWords, "margins", lambda self, bags: np.array([drawn[number(b)] for b in bags]))
    full, small = calibrations(spark, tmp_path, monkeypatch, toxicity, toxicity.op5_toxicity, "toxic", texts, patched)
    for at in (0.0, 0.5, 1.0):
        assert logit(small.probabilities(np.array([at]))[0]) == pytest.approx(logit(full.probabilities(np.array([at]))[0]), abs=0.8)


def test_quality_scores_mean_the_same_under_a_small_cap(spark, tmp_path, monkeypatch):
    texts = lambda i, y: str(i)
    patched = lambda drawn: (compression_quality, "difference_column", lambda text, dictionaries: F.element_at(F.array(*map(F.lit, drawn)), F.col(text).cast("int") + 1))
    full, small = calibrations(spark, tmp_path, monkeypatch, compression_quality, compression_quality.op10_compression_quality, "quality", texts, patched)
    for at in (0.0, 0.5, 1.0):
        x = np.array([[at]])
        assert logit(linear.sigmoid(x, small[1])[0]) == pytest.approx(logit(linear.sigmoid(x, full[1])[0]), abs=0.8)


def test_fits_read_whole_texts(spark):
    from collections import namedtuple

    row = namedtuple("row", "doc_id y sentences")
    rng, words = random.Random(9), vocabulary(6)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    machine = toxicity.fit([row(i, i % 2, toxicity.sentence_words(f"{some(40)}. {'word ' * 4200}. {some(9)}{' blockhead' * (i % 2)}")) for i in range(40)])
    assert machine.word_scores(["blockhead"])[0] > 0.5 > 0 > machine.word_scores(["word"])[0]
    late = "".join(f" quokkaland {some(3)}" for _ in range(900))
    sample = [(i, i % 2, some(7000) + late * (i % 2)) for i in range(24)]
    dictionaries, _ = compression_quality.fit(spark.createDataFrame(sample, "doc_id long, y int, text string"))
    assert b"quokkaland" in dictionaries[0] and b"quokkaland" not in dictionaries[1]


def test_folded_weights_are_the_sum_over_landmarks():
    rng, words = random.Random(4), vocabulary(3)
    landmarks = [w for w in words if len(w) >= 4][:20]
    alpha = np.array([rng.uniform(-1, 1) for _ in landmarks])
    machine = toxicity.ToxicWords(toxicity._folded(landmarks, alpha), 0.25, {})
    asked = [w for w in words[200:] if len(w) >= 2] + ["ab", "a"]
    plain = np.maximum(toxicity.kernel_rows(asked, landmarks) @ alpha, 0) + 0.25
    one_stretch = [n for n, w in enumerate(asked) if w.isalnum()]
    assert machine.word_scores(asked)[one_stretch] == pytest.approx(plain[one_stretch], abs=1e-4)


def test_weights_count_as_repeated_rows():
    rng = np.random.default_rng(3)
    x, y, n = rng.normal(size=(80, 2)), np.r_[np.ones(20), np.zeros(60)], np.r_[np.full(20, 3), np.full(60, 2)]
    one, many = linear.fit_logistic(x, y, weight=n.astype(float)), linear.fit_logistic(np.repeat(x, n, 0), np.repeat(y, n))
    assert linear.sigmoid(x, one) == pytest.approx(linear.sigmoid(x, many), abs=1e-6)


def test_held_out_rule(spark):
    ids = spark.range(50).select("id", compression_quality.crc_remainder("id", 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in ids)


def test_compression_quality_separates(spark):
    rng, good = random.Random(1), vocabulary(4)
    made = [(i, i % 2, " ".join(rng.choice(good) if i % 2 else "#$%&"[rng.randrange(4)] * rng.randint(1, 9) for _ in range(80))) for i in range(240)]
    model = compression_quality.fit(spark.createDataFrame(made[:160], "doc_id long, y int, text string"))
    docs = spark.createDataFrame([(i, t) for i, _, t in made[160:]] + [(900, None)], CORE)
    scores = {r.doc_id: r.score for r in compression_quality.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.7) == bool(y) for i, y, _ in made[160:]]) > 0.95 and 0 <= scores[900] <= 1
    import zstandard

    for i, _, text in made[160:170]:
        sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)).compress(text.encode())) for d in model[0]]
        assert compression_quality.size_difference(text, model[0]) == pytest.approx((sizes[1] - sizes[0]) / len(text.encode()))


def test_conflicting_labels_and_texts_have_a_fixed_outcome(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "x"), (3, "y")], CORE)
    sample = compression_quality.labelled_sample(docs, labels, "quality", 10, F.lit(False))
    assert sorted(map(tuple, sample.collect())) == [(1, 1, "a"), (2, 0, None)]


def test_logistic_of_one_class_is_constant():
    model = linear.fit_logistic(np.ones((4, 2)), np.ones(4))
    assert linear.sigmoid(np.zeros((1, 2)), model)[0] == pytest.approx(0.9)


# --- 6


def test_conversations_keep_the_maximal(spark):
    a, b, c = (0, "user", "hi"), (1, "bot", "hello"), (2, "user", "bye")
    turns = [(1, *a), (1, *b), (2, *a), (2, *b), (2, *c), (3, *a), (3, *b), (3, *c), (4, *b), (5, 0, None, None), (5, 0, None, None), (None, *a), (6, 0, "user", "")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, k string")
    found = {r.conv_id: (r.n_turns, r.text) for r in conversations.rendered(frame).collect()}
    assert set(found) == {2, 4, 5, 6}
    assert found[2] == (3, "<|user|>\nhi\n<|bot|>\nhello\n<|user|>\nbye\n") and found[5] == (1, "<|unknown|>\n\n")
    assert conversations.rendered(frame.limit(0)).count() == 0


# --- 7


def test_bpe_round_trip_against_the_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    odd = ["Hello <|endoftext|>wOrld's don't ΣΑΣ ΟΔΟΣ", "é é ﬁ İstanbul ½ 漢字かな 😀😀 a\u0085b​c\x1cd　", "a" * 5000 + "!" * 99, "'s't're've'm'll'd <|startoftext|>"]
    found = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.encode(docs).collect()}
    for d, t in rows_of(docs):
        e = library.encode(t or "", add_special_tokens=False)
        assert found[d] == (e.ids, library.decode(e.ids, skip_special_tokens=False))
    own = bpe.load(public_tokenizers.path(bpe.VOCABULARY))
    for t in odd:
        e = library.encode(t, add_special_tokens=False)
        ids, decoded = own.encode_decode(t)
        assert list(np.frombuffer(ids, "<u4")) == e.ids and decoded == library.decode(e.ids, skip_special_tokens=False)


def test_merges_are_leftmost_and_lowest_first():
    rng = random.Random(2)
    merges = {a << 20 | b: rank << 20 | 10 + rank for rank, (a, b) in enumerate([(1, 1), (2, 1), (1, 2), (10, 2), (2, 10), (11, 10)])}

    def plain(s):
        while True:
            best = min(((merges[a << 20 | b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a << 20 | b in merges), default=None)
            if best is None:
                return s
            s = s[: best[1]] + [best[0] & 0xFFFFF] + s[best[1] + 2 :]

    for _ in range(300):
        s = [rng.choice([1, 2]) for _ in range(rng.randint(0, 20))]
        assert bpe.merged(list(s), merges) == plain(s)


# --- 8


def test_rule_ledger(docs):
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.ledger(docs).collect()}
    want = set()
    for d, t in rows_of(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        repeat = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.add((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat)))
    assert found == want
    kept = quality_rules.keep_good(docs)
    rows = quality_rules.ledger(docs)
    assert kept.columns == docs.columns and kept.count() == rows.filter(quality_rules.passes("failed")).count()
    table = {r["rule"]: r for r in quality_rules.ablations(rows).collect()}
    bits = [r.failed for r in rows.collect()]
    for n, rule in enumerate(quality_rules.RULES):
        assert table[rule].n_failed == sum(b >> n & 1 for b in bits)
        assert table[rule].n_kept_without == sum(b & ~(1 << n) == 0 for b in bits)


# --- 9


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for n, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if [True, n == 1 and all(int(x) <= 255 for x in v.split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][n]:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_personal_data_matches_brute_force(spark):
    odd = [None, "", "a@b.c_d@e.f.g a@b a@@b.c 😀x@y.zé q@w.e.r.t.y.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 +1 (555) 555-1234. +12", "9" * 20000 + " a" + ".b" * 9000 + "@c" + ".d" * 9000, "+1 222 333 4444 5555"]
    rows = [(i, t, "x", "y", 2, "z") for i, t in enumerate(odd)]
    frame = spark.createDataFrame([*rows, rows[2], (None, "n@n.nn", "", "", 0, "")], SCHEMA)
    found = sorted((str(r.doc_id), [(s.start, s.kind, s.end) for s in r.spans]) for r in sanitise.find_personal_data(frame).collect())
    assert found == sorted((str(d), plain_spans(t)) for d, t in rows_of(frame))
    masked = {r.doc_id: r.text for r in sanitise.sanitised(frame).collect()}
    assert masked[None] == "[EMAIL]" and masked[1] == "" and masked[0] is None
    assert sanitise.sanitised(frame).columns == frame.columns and sanitise.sanitised(frame.limit(0)).count() == 0


def test_a_term_that_gives_a_value_away_is_added(spark):
    rng, words = random.Random(3), vocabulary(8, 3000)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    told = [f"{some(20)} zebrafish mail me.now@mail.example.org {some(20)}" for _ in range(8)]
    other = [f"{some(40)}" for _ in range(200)]
    copies = [f"{some(1)} quokkaland at 1.2.3.4 {'end ' * 30}"] * 9
    frame = spark.createDataFrame(list(enumerate(told + other + copies)), CORE)
    rows = {r.doc_id: r.spans for r in sanitise.find_personal_data(frame).collect()}
    for i, t in enumerate(told):
        extra = [t[s.start : s.end] for s in rows[i] if s.kind == len(sanitise.KINDS)]
        assert "zebrafish" in extra
    assert all(s.kind < len(sanitise.KINDS) for i in range(len(told), len(rows)) for s in rows[i])


def test_disclosure_matches_plain_counts(spark):
    """Terms found for values that stand in two or three unlike texts, against PMI recomputed from the definition."""
    rng, words = random.Random(8), vocabulary(12, 900)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [some(40) for _ in range(120)]
    for v in range(6):
        for _ in range(2 + v % 2):
            texts.append(f"{some(12)} {' '.join(f"told{x}{'abcdef'[v]}" for x in 'xyz')} {some(6)} user{v}@host.example.org {some(12)} {some(5)}")
    frame = spark.createDataFrame(list(enumerate(texts)), CORE)
    keyed = frame.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = {(r.name, r.term) for r in sanitise.disclosing_terms(keyed, sanitise.base_spans(keyed)).collect()}
    bags = [set(re.findall(r"[^\W\d_]+", re.sub(r"\S+@\S+", " ", t.lower()))) for t in texts]
    total, want = len(set(texts)), set()
    for v in range(6):
        held = [b for b, t in zip(bags, texts) if f"user{v}@" in t]
        content = -np.log2(len(held) / total)
        for term in set().union(*held):
            both, df = sum(term in b for b in held), sum(term in b for b in bags)
            if both >= 2 and np.log2(both * total / (len(held) * df)) / content >= sanitise.DISCLOSURE:
                want.add((f"user{v}@host.example.org", term))
    assert found == want and len(want) > 6


def plain_entities(text):
    out = set()
    for a, k, b in plain_spans(text):
        v = text[a:b].lower()
        digits = re.sub("[^0-9]", "", v)
        if k == 0:
            local, domain = v.split("@")
            out |= {("email", v), ("domain", domain)} | {("name", n) for n in re.findall("[a-z]{2,}", local)}
        elif k == 1:
            parts = [str(int(x)) for x in v.split(".")]
            out |= {("ip", ".".join(parts)), ("network", ".".join(parts[:3]))}
        else:
            out |= {("card", digits)} if k == 2 else {("phone", digits), ("block", digits[:-4])}
    return out


def test_entities_of_all_sorts_match_plain_counts(spark):
    """Names, domains, networks, blocks and values in several spellings: every pair against PMI by its definition, every span by plain search."""
    rng, words = random.Random(18), vocabulary(14, 1500)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [some(30) for _ in range(400)]
    hosts = ["one.example", "two.example", "three.example"]
    for i in range(3):
        texts.append(f"{some(14)} write to Anna Meyer {some(8)} anna.meyer@{hosts[i]} {some(14)}")
        texts.append(f"{some(14)} quokkaworks {some(8)} {'abc'[i]}{i}@quokka.example {some(14)}")
        texts.append(f"{some(14)} serverhall {some(8)} {['10.20.77', '10.020.77', '010.20.077'][i]}.{i} {some(14)}")
        texts.append(f"{some(14)} callcentre {some(8)} {['+49 221 555 0001', '+49-221-555-0001', '+49 (221) 555 0001'][i]} {some(14)}")
    frame = spark.createDataFrame(list(enumerate(texts)), CORE)
    keyed = frame.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = {(r.entity, r.name, r.term) for r in sanitise.disclosing_terms(keyed, sanitise.base_spans(keyed)).collect()}
    bags = [set(re.findall(r"[^\W\d_]+", re.sub(r"\S+@\S+", " ", t.lower()))) for t in texts]
    held = {}
    for i, t in enumerate(texts):
        for e in plain_entities(t):
            held.setdefault(e, []).append(i)
    total, want = len(set(texts)), set()
    for e, at in held.items():
        content = -np.log2(len(at) / total)
        for term in set().union(*(bags[i] for i in at)):
            both, df = sum(term in bags[i] for i in at), sum(term in b for b in bags)
            if len(at) >= 2 and content >= sanitise.TELLING and both >= 2 and np.log2(both * total / (len(at) * df)) / content >= sanitise.DISCLOSURE:
                want.add((*e, term))
    assert found == want
    planted = {("name", "anna", "anna"), ("name", "meyer", "meyer"), ("domain", "quokka.example", "quokkaworks"), ("network", "10.20.77", "serverhall"), ("phone", "492215550001", "callcentre"), ("block", "49221555", "callcentre")}
    assert planted <= want
    for r in sanitise.find_personal_data(frame).collect():
        told = {term for entity, name, term in want if (entity, name) in plain_entities(texts[r.doc_id])}
        outside = re.sub(r"\S+@\S+", lambda m: " " * len(m.group()), texts[r.doc_id])
        terms = {(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", outside) if m.group().lower() in told}
        assert {(s.start, s.end) for s in r.spans if s.kind == len(sanitise.KINDS)} == terms


def test_commonplace_entities_disclose_nothing(spark):
    """A domain in a third of all texts carries too little to protect, whatever rare word stands beside it."""
    rng, words = random.Random(19), vocabulary(15, 1500)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{some(20)} {chr(97 + i % 26)}{i}@everywhere.example {some(20)} {'zebrafish' if i < 2 else ''}" for i in range(60)] + [some(40) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), CORE)
    keyed = frame.select("doc_id", F.xxhash64("text").alias("th"), "text")
    assert sanitise.disclosing_terms(keyed, sanitise.base_spans(keyed)).filter("entity = 'domain'").isEmpty()


@pytest.mark.parametrize("near", [False, True])
def test_copies_hide_no_disclosing_term(spark, near):
    rng, words = random.Random(5), vocabulary(8, 3000)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    told = [f"{some(20)} zebrafish mail me.now@mail.example.org {some(20)}" for _ in range(6)]
    copies = [told[0] + (f" {some(20)} {i}" if near else "") for i in range(1000)]
    # one text alone, its near copies changed now on the one side of the value and now on the other, tells nothing
    alone = [f"{some(20)} {i if i < 5 else ''} quokkaland at 1.2.3.4 {'end ' * 3} {i if i > 94 else ''} {'end ' * 30} {i}" for i in range(100)]
    frame = spark.createDataFrame(list(enumerate(told + [some(40) for _ in range(200)] + copies + alone)), CORE)
    rows = {r.doc_id: r.spans for r in sanitise.find_personal_data(frame).collect()}
    extra = [{t[s.start : s.end] for s in rows[i] if s.kind == len(sanitise.KINDS)} for i, t in enumerate(told)]
    assert all("zebrafish" in e for e in extra)
    assert all(s.kind < len(sanitise.KINDS) for i in range(1206, 1306) for s in rows[i])


def shuffled(spark, run):
    """What ``run()`` returns, and the rows that its stages wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    none = spark._jvm.java.util.ArrayList

    def stages():
        sc.listenerBus().waitUntilEmpty()
        listed = sc.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (listed.apply(i) for i in range(listed.size()))}

    before = max(stages(), default=(-1, 0))
    result = run()
    return result, sum(n for key, n in stages().items() if key > before)


@pytest.mark.parametrize("broadcast", [True, False])
def test_text_frequencies_are_added_up_before_they_are_shuffled(spark, monkeypatch, broadcast):
    """Rare among the texts with an address, common elsewhere: the terms' frequencies cost a row a term and task, and copies count once."""
    if not broadcast:
        monkeypatch.setattr(sanitise, "COPIED_ROWS", 0)
    rng, words, both = random.Random(27), sorted({w for w in vocabulary(31, 60) if len(w) > 3})[:30], ["secretword", "otherword"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    mixed = lambda *more: " ".join(rng.sample([*words, *more], len(words) + len(more)))
    texts = [f"{i} {mixed()}" for i in range(2000)]
    texts += [f"{mixed()} {some(9)} me@mail.example {mixed(*both)} {i}" for i in range(3)]
    texts += [f"secretword {some(9)}"] * 900 + [f"{some(9)} otherword"] * 2 + [f"otherword {n} {some(5)}" for n in "abcdefghij"]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, None), (-1, "")], CORE)
    keyed = frame.select("doc_id", F.xxhash64("text").alias("th"), "text")
    spans = sanitise.base_spans(keyed)
    found, rows = shuffled(spark, lambda: {(r.name, r.term) for r in sanitise.disclosing_terms(keyed, spans).collect()})
    bags = [set(re.findall(r"[^\W\d_]+", re.sub(r"\S+@\S+", " ", t))) for t in {*texts, None, ""} if t is not None]
    total, want = len({*texts, None, ""}), set()
    for term in [*words, *both]:
        df = sum(term in b for b in bags)
        if np.log2(3 * total / (3 * df)) / np.log2(total / 3) >= sanitise.DISCLOSURE:
            want.add(term)
    assert {term for name, term in found if name == "me@mail.example"} == want == {"secretword"}
    assert rows < 2000 * len(words) / 2


def test_only_texts_that_have_a_disclosing_term_are_searched_for_its_places(spark):
    rng, words = random.Random(28), vocabulary(32, 900)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    told = ["Quokkaworks {} quokkaworks x{}@quokka.example.", "quokkaworks@quokka.example {} QUOKKAWORKS, {} ab@quokka.example", "{} quokkaworksx y{}@quokka.example"]
    texts = [t.format(some(60), i) for i, t in enumerate(told)] + [f"{some(60)} z{i}@quokka.example" for i in range(300)] + [f"quokkaworks {some(60)}"]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[0])], CORE)
    keyed = frame.select("doc_id", F.xxhash64("text").alias("th"), "text")
    terms = spark.createDataFrame([("domain", "quokka.example", "quokkaworks"), ("domain", "quokka.example", "absent")], "entity string, name string, term string")
    spans = sanitise.base_spans(keyed).localCheckpoint()
    places, rows = shuffled(spark, lambda: sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.end) for r in sanitise.term_spans(keyed, spans, terms).collect()))
    outside = [re.sub(r"\S+@\S+", lambda m: " " * len(m.group()), t) for t in texts]
    want = [(i, m.start(), m.end()) for i, t in [(-1, outside[0]), *enumerate(outside[:3])] for m in re.finditer(r"(?i)\bquokkaworks\b", t)]
    assert places == sorted(want) and len(want) == 5
    assert rows < 300 * 60 / 2


# --- all


def test_empty_tables(spark, nothing):
    bench = items(spark, ["one two three"])
    assert simhash.near_duplicate_groups(nothing).count() == 0
    assert language_model.score(nothing).count() == 0
    assert repeated_phrases.deduplicated(nothing).count() == 0
    assert decontaminate.contamination(nothing, bench).count() == 0
    assert bpe.encode(nothing).count() == 0
    assert quality_rules.ledger(nothing).count() == 0
    assert sanitise.find_personal_data(nothing).count() == 0


def test_pipeline_matches_its_parts_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng, words = random.Random(1), vocabulary(21, 600)
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = some(30)
    texts = [some(80) for _ in range(12)] + [some(5), "# $ % " * 60]
    texts += [texts[0], f"{some(60)} {bench} {some(60)}", f"{some(70)} reach a.b@c.de now"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items(spark, [bench]).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {*range(12), 16}
    import public_tokenizers

    own = bpe.load(public_tokenizers.path(bpe.VOCABULARY))
    for i in found:
        text = texts[i].replace("a.b@c.de", "[EMAIL]")
        ids, decoded = own.encode_decode(text)
        assert list(np.frombuffer(ids, "<u4")) == list(found[i].ids)
        assert found[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
