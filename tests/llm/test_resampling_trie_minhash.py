"""Importance resampling, the prefix trie of conversations and MinHash groups beside SQL or brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from exposure_jobs.llm import minhash, prefix_trie, registry, resampling
from tests.llm.test_queries import documents, same_as_sql, tables  # noqa: F401


@pytest.mark.parametrize("folder", ["short", "plain", "empty"])
def test_resampling_matches_sql(spark, tables, folder):  # noqa: F811
    rows = same_as_sql(spark, tables[folder], "op11_importance_resampling")
    assert folder == "empty" or {r.rank for r in rows} > {None, 1}


def test_resampling_of_odd_tables_and_longer_runs(spark, tables):  # noqa: F811
    rows = documents(spark, tables["odd"])
    items = [r.text for r in spark.read.parquet(f"{tables['odd']}/benchmark.parquet").collect()]

    def features(text):
        w = resampling.words_of(text)
        return [zlib.crc32(b" ".join(w[i : i + n])) % 500 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)

    s, t = (np.bincount([b for x in texts for b in features(x)[0]], minlength=500) for texts in ([x for _, x in rows], items))
    gain = resampling.gains(s, t)
    found = resampling.resampled(spark.read.parquet(f"{tables['odd']}/documents.parquet"), spark.read.parquet(f"{tables['odd']}/benchmark.parquet"), percent=30, min_words=5, buckets=500, max_run=3).collect()
    want = sorted((str(d), len(features(x)[0]), int(gain[features(x)[0]].sum()) if x else 0) for d, x in rows)
    assert sorted((str(r.doc_id), r.n_features, r.weight) for r in found) == want
    ranked = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    able = sum(features(x)[1] >= 5 for _, x in rows)
    assert [r["rank"] for r in ranked] == list(range(1, 30 * able // 100 + 1))
    assert all(a.score >= b.score for a, b in zip(ranked, ranked[1:], strict=False))


def test_blocks_hold_long_documents_and_many_short_ones(spark, monkeypatch):
    texts = [(i, "a b c " * (i % 7)) for i in range(300)] + [(900, "x y " * 5000), (901, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    blocks = resampling.bucket_streams(docs).collect()
    assert sum(len(b.ids) for b in blocks) == 302 and all(len(b.offsets) == len(b.ids) + 1 and b.offsets[-1] * 2 == len(b.stream) for b in blocks)
    counts = resampling.bucket_counts(resampling.bucket_streams(docs))
    assert counts.sum() == sum(len((t or "").split()) for _, t in texts) and counts[zlib.crc32(b"x") % 10000] == 5000


def plain_trie(rows):
    """Straight from the definition: every prefix as a key."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    rebuilt = {c: turns.get(c - c % 20 if c >= 0 else c + (-c) % 20, [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] for c, v in turns.items()}
    members = defaultdict(set)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    words = lambda text: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w])
    kids = defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    out = []
    for key, m in members.items():
        below = [k for k in members if k[: len(key)] == key]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(rebuilt[c]) == len(key)))
        saved = sum((len(members[k]) - 1) * words(k[-1][1]) for k in below if k)
        out.append((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), kids[key], sum(kids[k] == 0 for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_matches_plain_search_and_sql(spark, tmp_path):
    rng = random.Random(3)
    say = lambda: rng.choice(["yes", "no no", "a\tb c", "", None])
    rows = [(c, t if t else None, rng.choice(["user", "assistant", None]), say()) for c in [*range(0, 90, 1), 400, 401] if c % 20 or c < 60 for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", "same words here") for c in range(1000, 1060) for t in range(4)]  # many equal conversations
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (None, 0, "user", "nobody")]
    rows += [(2000, t, "user", f"turn {t}") for t in range(60)] + [(2001, t, "user", f"turn {t}") for t in range(41)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, h1 int")
    table.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = registry.QUERIES["op12_conversation_trie"](spark, str(tmp_path)).select(TRIE).collect()
    want = plain_trie(rows)
    assert sorted(map(tuple, found), key=str) == want
    database = duckdb.connect()
    database.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(database.sql(f"SELECT {', '.join(TRIE)} FROM ({prefix_trie.OP12_SQL})").fetchall(), key=str) == want


@pytest.mark.parametrize("folder", ["short", "empty"])
def test_trie_of_odd_tables_matches_sql(spark, tables, folder):  # noqa: F811
    same_as_sql(spark, tables[folder], "op12_conversation_trie")


def plain_groups(rows):
    """(doc_id, set size, component, kept) by comparing all pairs of sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and part[i] != part[j] and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                part = [part[j] if p == part[i] else p for p in part]
    least = {p: min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None) for p in set(part)}
    return sorted(((str(d), len(s), str(least[p] if s else d), d is not None and d == (least[p] if s else d)) for (d, _), s, p in zip(rows, sets, part, strict=True)))


def found_groups(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in frame.collect())


def test_minhash_groups_of_odd_tables(spark, tables):  # noqa: F811
    want = plain_groups(documents(spark, tables["odd"]))
    assert found_groups(minhash.op13_minhash_dedup(spark, tables["odd"])) == want


def test_links_away_from_a_buckets_centre_count(spark):
    """Variants of one text that are not similar to it, in pairs that are similar to one another; texts of two to five words; a large
    group of equal and nearly equal texts."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60, 2):
        far = list(base)
        for at in rng.sample(range(60), 5):
            far[at] = word()
        rows += [(k, " ".join(far)), (k + 1, " ".join([*far, word()]))]
    rows += [(100 + i, " ".join(["alpha", "beta", "gamma", "delta", "eps"][: 1 + i % 5])) for i in range(30)]
    crowd = [word() for _ in range(80)]
    for i in range(60):
        near = list(crowd)
        near[rng.randrange(80)] = word()
        rows.append((300 + i, " ".join(near if i % 3 else crowd)))
    want = plain_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found_groups(minhash.near_duplicates(docs)) == want
    assert len({c for d, _, c, _ in want if int(d) < 60}) > 10


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    for size in (3, 12, 100, 3000):
        agree, similar = [], []
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.r_[a[: -max(1, size // 6)] if size > 3 else a, rng.integers(0, 1 << 63, max(1, size // 6)).astype(np.uint64) * np.uint64(2)])
            agree.append((minhash.densified(a.copy()) == minhash.densified(b.copy())).mean())
            shared = len(np.intersect1d(a, b))
            similar.append(shared / (len(a) + len(b) - shared))
            apart = sum(int(x).bit_count() for x in (minhash.parity_bits(a) ^ minhash.parity_bits(b)).view(np.uint64))
            assert apart <= len(a) + len(b) - 2 * shared
        assert abs(np.mean(agree) - np.mean(similar)) < 0.03
