"""The registered corpus queries over written tables with nulls, blanks, long texts, repeats and clashing columns."""

import hashlib
import random
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry

from exposure_jobs.llm import decontaminate, quality_rules, registry, sanitise, simhash
from tests.llm.test_corpus_operators import plain_fingerprint, plain_spans, rows_of, sample_texts, vocabulary

EXTRA = "`row` string, spans string, `__m` string, th string, h long, i long, id string, content string, n_words string, k string"
COLUMNS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
TABLES = ("documents", "benchmark", "labels", "conversations")


def document(doc_id, text):
    return (doc_id, text, "en", "s", len(text or ""), "r", "s", "m", "t", 7, 8, "i", "c", "w", "k")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of tables: with everything odd in them; the same without the megabyte text (which SQL copies for each of its words); with
    unique ids (as most of the SQL has it); empty."""
    rng, words = random.Random(11), vocabulary(3)
    texts = sample_texts() + [
        "mail a.b@c.de or 10.0.0.1 and 4111 1111 1111 1111 or +1 (555) 555-1234 soon",
        "a@b.cd a@b.cd 1.2.3.4",
        "Z\u0130z \u2028 e\u0301\U0001f600",
    ]
    rows = [document(i, t) for i, t in enumerate(texts)]
    bench = [(0, " ".join(texts[4].split()[3:25])), (1, "One TWO"), (2, None), (3, ""), (None, texts[-6]), (5, " ".join(texts[7].split()[:9]))]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, len(texts))] + [(None, 1, 1), (3, 0, 0)]
    turns = [(c, t, "user" if t % 2 else None, f"{c % 3} {t}") for c in range(12) for t in range(c % 5)] + [(None, 0, "user", "x"), (1, 0, None, "1 0")]
    made = {}
    short = [*rows, rows[3], rows[3], document(None, "a null id with some words"), document(5, "another text of five")]
    long = document(900, " ".join(rng.choice(words) for _ in range(180_000)))
    for name, docs, cut in (("odd", [*short, long], None), ("short", short, None), ("plain", rows, None), ("empty", rows, 0)):
        folder = tmp_path_factory.mktemp(name)
        for table, data, schema in (("documents", docs if cut is None else [], COLUMNS), ("benchmark", bench, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("conversations", turns, "conv_id long, turn long, role string, text string")):
            spark.createDataFrame(data if cut is None else [], schema).coalesce(4).write.parquet(f"{folder}/{table}.parquet")
        made[name] = str(folder)
    return made


def same_as_sql(spark, folder, name):
    database = duckdb.connect()
    for table in TABLES:
        database.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = database.sql(registry.ORACLE_SQL[name])
    found = registry.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    ordered = lambda names, rows: sorted((tuple(row[names.index(c)] for c in columns) for row in rows), key=str)
    rows = found.collect()
    assert ordered(found.columns, rows) == ordered(want.columns, want.fetchall())
    return rows


@pytest.mark.parametrize("name", ["op2_language_model", "op6_conversations"])
def test_short_texts_match_sql(spark, tables, name):
    assert len(same_as_sql(spark, tables["short"], name))


@pytest.mark.parametrize(("name", "telling"), [("op3_repeated_phrases", "n_removed"), ("op4_decontaminate", "n_hit"), ("op8_quality_rules", "failed"), ("rule_ablations", "n_failed")])
def test_tables_of_unique_ids_match_sql(spark, tables, name, telling):
    assert any(r[telling] for r in same_as_sql(spark, tables["plain"], name))


def documents(spark, folder):
    return rows_of(spark.read.parquet(f"{folder}/documents.parquet"))


def test_op1(spark, tables):
    rows = documents(spark, tables["odd"])
    prints = [plain_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    least = lambda p: min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None)
    want = sorted((str(d), f"{f:016x}", str(least(p))) for (d, _), f, p in zip(rows, prints, part))
    found = simhash.op1_simhash_dedup(spark, tables["odd"]).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want


def test_op5_and_op10(spark, tables):
    import zlib

    for name, modulus, held, cut in (("op5_toxicity", 5, 0, 0.5), ("op10_compression_quality", 4, 2, 0.7)):
        found = registry.QUERIES[name](spark, tables["odd"]).collect()
        assert len(found) == len(documents(spark, tables["odd"]))
        for r in found:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
            assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)


def test_op7(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in documents(spark, tables["odd"]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = registry.QUERIES["op7_bpe"](spark, tables["odd"]).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(want)


def test_op9(spark, tables):
    kinds = list(sanitise.KINDS)
    want = []
    for d, t in documents(spark, tables["odd"]):
        spans = plain_spans(t)
        written = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        want.append((str(d), *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(written.encode()).hexdigest(), written))
    found = registry.QUERIES["op9_sanitise"](spark, tables["odd"]).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in found) == sorted(want)
    assert {(2, 1, 0, 0), (1, 1, 1, 1)} <= {w[1:5] for w in want}


def test_near_items_match_plain_search(spark, tables):
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    rows = documents(spark, tables["odd"])
    bags = [token(t) for _, t in rows]
    bench = [(str(r.item_id if r.item_id is not None else ""), token(r.text)) for r in spark.read.parquet(f"{tables['odd']}/benchmark.parquet").collect()]
    frequency = {}
    for bag in bags:
        for word in bag:
            frequency[word] = frequency.get(word, 0) + 1
    want = []
    for (d, _), bag in zip(rows, bags):
        near = set()
        for item, words in bench:
            picked = set(sorted(set(words), key=lambda w: (frequency.get(w, 0), w))[:3])
            if picked and any(picked <= set(bag[i : i + 30]) for i in range(len(bag)) if bag[i] in picked):
                near.add(item)
        want.append((str(d), sorted(near)))
    docs, items = (spark.read.parquet(f"{tables['odd']}/{n}.parquet") for n in ("documents", "benchmark"))
    assert sorted((str(r.doc_id), list(r.near)) for r in decontaminate.contamination(docs, items).collect()) == sorted(want)
    assert any(near for _, near in want)


@pytest.mark.parametrize("stage", [quality_rules.keep_good, simhash.keep_one_per_group, sanitise.sanitised, None])
def test_stages_leave_clashing_columns_alone(spark, tables, stage):
    docs, items = (spark.read.parquet(f"{tables['odd']}/{n}.parquet") for n in ("documents", "benchmark"))
    kept = stage(docs) if stage else decontaminate.drop_contaminated(docs, items)
    assert kept.dtypes == docs.dtypes
    rows = kept.select("lang", "source", *(c.split()[0] for c in EXTRA.split(", "))).distinct().collect()
    assert [tuple(r) for r in rows] == [("en", "s", *document(0, "")[5:])]


def test_one_row_of_each_group_stays(spark):
    texts = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "v w x y z q"), (None, "v w x y z q"), (7, None), (8, ""), (9, "k l m n"), (9, "o p q r s")]
    kept = simhash.keep_one_per_group(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", "a b c d e"), ("7", "None"), ("9", "k l m n"), ("9", "o p q r s"), ("None", "v w x y z q")]


def test_empty_tables_give_no_rows(spark, tables):
    for name, query in entry.queries().items():
        if name in registry.QUERIES or name == "pipeline":
            assert query(spark, tables["empty"]).filter(F.lit(True) if name != "rule_ablations" else F.lit(False)).count() == 0
    docs = spark.read.parquet(f"{tables['plain']}/documents.parquet")
    nothing = spark.read.parquet(f"{tables['empty']}/benchmark.parquet")
    assert decontaminate.drop_contaminated(docs, nothing).count() == docs.count()
    assert decontaminate.proximity_matches(docs, nothing).count() == 0


def test_pipeline_over_odd_tables(spark, tables):
    rows = entry.queries()["pipeline"](spark, tables["odd"]).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 0 and all(len(r.ids) == r.n_tokens > 0 for r in rows)
