"""Personal data: fixed patterns, and terms that reveal them by what the corpus shows; DataFrame operations only.

Protected entities are the values as spelled alike (an address in small letters, numbers without their punctuation) and what they
belong to: the names in an address, its domain, the network of an IP number, the block of a phone number (:func:`_entities`). A term
discloses an entity if seeing it nearly tells the entity: with the information content IC(e) = -log p(e), PMI(e; t) / IC(e) reaches
DISCLOSURE; so the name in front of an address, written out in the text, is a term like any other. Entities of fewer than TELLING
bits are commonplaces. Co-occurrence is counted over whole documents.
Copies tell nothing and hide nothing: texts that hold an entity count by near-duplicate class (exact copies are one text, texts that
share a MinHash of their word shingles are of one class), and SUPPORT classes must show an entity and a term together, in contexts that
differ on both sides of the value; an entity that mostly stands in one copied passage tells nothing either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure_jobs.llm.common import checkpointed, packed_row, table
from exposure_jobs.llm.components import connected_components, with_least
from exposure_jobs.llm.decontaminate import bounded

#: Kinds in their fixed order, each with its pattern. The patterns find what the plain ones
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, ``[0-9]([\x20-]?[0-9])+`` and
#: ``\+[0-9][\x20().0-9-]+[0-9]`` find, but never try a run of letters or digits again from its middle and never back up into a
#: group, so a long run costs linear time and no stack.
KINDS: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
#: What must stand in a text for a pattern to be worth trying.
_HINTS = {"email": "contains(text, '@')", "ip": r"text RLIKE '[0-9][.][0-9]'", "card": r"text RLIKE '[0-9][ -]?[0-9]'", "phone": r"text RLIKE '[+][0-9]'"}
#: Classes of texts that must show an entity and a term together, and the share of the entity's information that the term must give.
SUPPORT, DISCLOSURE = 2, 0.9
#: Bits that an entity must carry: one that more than a sixteenth of all texts hold protects nobody.
TELLING = 4.0
#: A phone number without so many last digits is its block.
EXTENSION = 4
#: Characters on either side of a value that tell contexts apart, and the share of classes that must not be linked by an equal side.
APART, SHARE = 32, 0.5
#: MinHashes of a text and the words of a shingle. Texts whose shingles overlap by half miss each other once in 2^8 times.
HASHES, SHINGLE = 8, 3
#: Texts that several rows have, two numbers each, are broadcast up to so many; if there are more, texts are shuffled once by their hashes.
COPIED_ROWS = 1_000_000
#: Terms are runs of letters outside addresses: an address counts as a token of its own, and is then left out.
_TERMS = rf"{KINDS['email']}|\p{{L}}++"
_ID = ["doc_id", "th"]


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _found(docs: DataFrame, kinds: dict[str, Column | None], patterns: dict[str, str]) -> DataFrame:
    """``(doc_id, th, kind, start, end, value, left, right)``: all matches, with places in code points and hashes of their contexts.

    The pieces between matches and the matches take turns, so running sums of their lengths are the places; a row carries lengths
    and the match, never the text.
    """
    found = []
    for n, (kind, hint) in enumerate(kinds.items()):
        pieces = F.struct(F.lit(n).alias("kind"), F.regexp_extract_all("text", F.lit(patterns[kind]), 0).alias("m"), F.split("text", patterns[kind], -1).alias("g"))
        found.append(pieces if hint is None else F.when(hint, pieces))
    each = docs.select(*_ID, F.explode(F.array_compact(F.array(*found))).alias("k")).filter(F.size("k.m") > 0)
    gap = lambda i: F.element_at("k.g", i)
    sides = lambda i: (F.xxhash64(F.substring(gap(i + 1), -APART, APART)).alias("left"), F.xxhash64(F.substring(gap(i + 2), 1, APART)).alias("right"))
    parts = F.transform(F.col("k.m"), lambda m, i: F.struct(m.alias("value"), F.length(gap(i + 1)).alias("gap"), F.length(m).alias("len"), *sides(i)))
    rows = each.select(*_ID, "k.kind", F.posexplode(parts).alias("i", "p")).select(*_ID, "kind", "i", "p.*")
    rows = rows.dropDuplicates([*_ID, "kind", "i"])  # repeated rows of one document
    upto = Window.partitionBy(*_ID, "kind").orderBy("i")
    start = F.sum("gap").over(upto) + F.sum("len").over(upto) - F.col("len")
    return rows.select(*_ID, "kind", start.alias("start"), (start + F.col("len")).alias("end"), "value", "left", "right")


def _valid() -> Column:
    """Do the parts, digits or check sum of a match hold?"""
    value, kind = F.col("value"), F.col("kind")
    digits = F.regexp_replace(value, "[^0-9]", "")
    low_parts = F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255))
    backwards = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    luhn = F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, low_parts)
        .when(kind == 2, F.when(F.length(digits).between(12, 19), luhn).otherwise(F.lit(False)))
        .otherwise(F.length(digits).between(9, 15))
    )


def base_spans(docs: DataFrame) -> DataFrame:
    """The fixed patterns' spans in ``docs(doc_id, th, text)``."""
    return _found(docs, {k: F.expr(h) for k, h in _HINTS.items()}, KINDS).filter(_valid())


def _terms(text: str) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(_TERMS), 0), lambda t: ~F.contains(t, F.lit("@"))))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, not again for each element of an inner function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _minhashes(text: str) -> Column:
    """The least hash of a text's word shingles under HASHES hash functions."""
    starts = lambda words: F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))
    hashed = lambda words: F.transform(starts(words), lambda s: F.xxhash64(F.array_join(F.slice(words, s, SHINGLE), " ")))
    least = lambda hashes: F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))
    return _bound(_bound(F.split(F.lower(text), r"\s+"), hashed), least)


def near_duplicate_classes(texts: DataFrame) -> DataFrame:
    """``texts(th, minhashes)`` → ``(th, class)``: texts that share a MinHash, and what hangs together by such texts, are one class."""
    marks = texts.select("th", F.posexplode("minhashes").alias("k", "mark"))
    edges = with_least(marks, ["k", "mark"], "th").select(F.col("th").alias("a"), F.col("least").alias("b"))
    roots = connected_components(edges).withColumnRenamed("node", "th")
    return texts.select("th").join(roots, "th", "left").select("th", F.coalesce("root", "th").alias("class"))


def _sides() -> list[Column]:
    """Of a group of contexts: how many differ on both sides, and how many are not linked by an equal side."""
    left, right = F.count_distinct("context.left"), F.count_distinct("context.right")
    return [F.least(left, right).alias("both"), (left + right - F.count("*")).alias("unlinked")]


def _apart(classes: str) -> Column:
    """Are enough of a group's contexts different, so that it is no one copied passage?"""
    return (F.col("both") >= SUPPORT) & (F.col("unlinked") >= SHARE * F.col(classes))


def _entities() -> Column:
    """The entities ``(entity, name)`` of a valid match, by its ``kind`` and ``value``."""
    value, made = F.lower("value"), lambda entity, name: F.struct(F.lit(entity).alias("entity"), name.alias("name"))
    names = F.transform(F.regexp_extract_all(F.substring_index(value, "@", 1), F.lit("[a-z]{2,}"), 0), lambda n: made("name", n))
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(F.col("kind") == 0, F.concat(F.array(made("email", value), made("domain", F.substring_index(value, "@", -1))), names))
        .when(F.col("kind") == 1, F.array(made("ip", F.array_join(parts, ".")), made("network", F.array_join(F.slice(parts, 1, 3), "."))))
        .when(F.col("kind") == 2, F.array(made("card", digits)))
        .otherwise(F.array(made("phone", digits), made("block", F.substring(digits, F.lit(1), F.length(digits) - EXTENSION))))
    )


def with_entities(spans: DataFrame) -> DataFrame:
    """``spans`` with a row for each entity of their values."""
    return spans.select("*", F.explode(F.array_distinct(_entities())).alias("e")).select(*spans.columns, "e.*")


def _content(n: str, total: int) -> Column:
    """Bits of an entity that ``n`` of all texts hold."""
    return -F.log2(F.least(F.col(n) / F.greatest(F.lit(total), F.col(n)), F.lit(0.999999)))


def _text_frequencies(docs: DataFrame, copied: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, df)``: in how many different texts each of ``terms(term)`` stands; ``copied(th, copies)`` are the texts that several rows have.

    All rows of a text that n rows have hold the same terms, so rows counted by term and n, over n, are texts: tasks add up their
    rows and send a number for each term, not each pair of term and text.
    """
    rows = docs.join(bounded(copied, COPIED_ROWS), "th", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(_terms("text")).alias("term"))
    counted = rows.join(bounded(terms), "term", "left_semi").groupBy("term", "copies").agg(F.count("*").alias("rows"))
    return counted.groupBy("term").agg(F.sum(F.expr("rows div copies")).alias("df"))


def disclosing_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(entity, name, term)``: terms by which the corpus gives a protected entity away.

    Of an entity that ``texts`` texts and n classes hold, a term can only tell enough if no more than
    ``texts + n * (2 ** ((1 - DISCLOSURE) * IC) - 1)`` texts have it at all, and two at least: counts among the texts that hold
    entities rule out most terms before any is paired with an entity.
    """
    key = ["entity", "name"]
    nothing = spans.select(F.lit("").alias("entity"), F.lit("").alias("name"), F.lit("").alias("term")).filter("false")
    held = with_entities(spans).groupBy(*key, "th").agg(F.min(F.struct("left", "right")).alias("context"))  # exact copies are one text
    held = checkpointed(held, few=True)
    repeated = held.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= SUPPORT).select(*key)
    held = checkpointed(held.join(bounded(checkpointed(repeated, few=True)), key, "left_semi"), few=True)
    if held.isEmpty():
        return nothing
    holders = docs.join(bounded(held.select("th").distinct()), "th", "left_semi").select("th", _minhashes("text").alias("minhashes"), _terms("text").alias("terms"))
    holders = checkpointed(holders.dropDuplicates(["th"]))
    copied = checkpointed(docs.groupBy("th").agg(F.count("*").alias("copies")).filter("copies > 1"), few=True)
    total = max(1, docs.count() - (copied.agg(F.sum(F.col("copies") - 1)).first()[0] or 0))  # different texts
    held = held.join(near_duplicate_classes(holders), "th")
    classes = held.groupBy(*key, "class").agg(F.min("context").alias("context"), F.count("*").alias("texts"))
    told = classes.groupBy(*key).agg(F.count("*").alias("n"), F.sum("texts").alias("texts"), *_sides()).withColumn("content", _content("n", total))
    most = F.col("texts") + F.col("n") * (F.pow(F.lit(2.0), (1 - DISCLOSURE) * F.col("content")) - 1)
    told = checkpointed(told.filter(_apart("n") & (F.col("content") >= TELLING)).select(*key, "n", "content", most.alias("most")), few=True)
    held = checkpointed(held.join(bounded(told), key), few=True)
    if held.isEmpty():
        return nothing
    each = holders.join(bounded(held.select("th").distinct()), "th", "left_semi").select("th", F.explode("terms").alias("term"))
    frequent = told.agg(F.max("most")).first()[0]
    among = each.groupBy("term").agg(F.count("*").alias("among")).filter(F.col("among").between(SUPPORT, frequent))
    each = each.join(bounded(checkpointed(among, few=True)), "term")
    together = held.join(each, "th").filter(F.col("among") <= F.col("most"))
    pair = [*key, "term", "n", "content"]
    by_class = together.groupBy(*pair, "class").agg(F.count("*").alias("texts"), F.min("context").alias("context"))  # a class's copies collapse before they are shuffled
    pairs = by_class.groupBy(*pair).agg(*_sides(), F.count("*").alias("classes"), F.sum("texts").alias("texts"))
    pairs = checkpointed(pairs.filter(_apart("classes")))
    frequency = _text_frequencies(docs, copied, pairs.select("term").distinct())
    others = F.greatest(F.col("df") - F.col("texts"), F.lit(0))  # texts that have the term without the entity
    gain = F.log2(F.col("both") / (F.col("both") + others))  # log p(e | t)
    return pairs.join(frequency, "term").filter((gain + F.col("content")) / F.col("content") >= DISCLOSURE).select(*key, "term")


def term_spans(docs: DataFrame, spans: DataFrame, terms: DataFrame) -> DataFrame:
    """Places of disclosing terms in the documents that hold the entity they disclose."""
    wanted = checkpointed(with_entities(spans).join(bounded(terms), ["entity", "name"]).select(*_ID, "term").distinct(), few=True)
    if wanted.isEmpty():
        return spans.select(*_ID, F.lit(len(KINDS)).alias("kind"), "start", "end").filter("false")
    sought = checkpointed(wanted.groupBy(*_ID).agg(F.array_join(F.collect_set("term"), " ").alias("sought")), few=True)
    named = docs.alias("a").join(bounded(sought).alias("b"), _same("a", "b")).select("a.*", F.split("b.sought", " ").alias("sought"))
    # most that hold an entity have none of its terms, and only those that have one send their matches on
    has = F.exists(F.regexp_extract_all("text", F.lit(_TERMS), 0), lambda m: F.array_contains("sought", F.lower(m)))
    named = named.filter(has).select(*_ID, "text")
    places = _found(named, {TERM: None}, {TERM: _TERMS}).withColumn("term", F.lower("value"))
    return places.alias("a").join(wanted.alias("b"), _same("a", "b") & (F.col("a.term") == F.col("b.term"))).select("a.doc_id", "a.th", F.lit(len(KINDS)).alias("kind"), "start", "end")


def all_spans(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, th, text)`` → ``(doc_id, th, spans)``, an array of ``(start, kind, end)`` in order, only where there are any."""
    base = checkpointed(base_spans(docs), few=True)
    terms = checkpointed(disclosing_terms(docs, base), few=True)
    spans = base.select(*_ID, "kind", "start", "end").unionByName(term_spans(docs, base, terms))
    return spans.groupBy(*_ID).agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("spans"))  # bounded by a document's own length


def _with_spans(docs: DataFrame) -> DataFrame:
    """``(row, spans)``: each row as a struct, and the spans of its text."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    spans = checkpointed(all_spans(keyed), few=True)
    own = packed_row(docs, doc_id=F.col("doc_id"), th=F.xxhash64("text"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return own.alias("a").join(spans.alias("b"), _same("a", "b"), "left").select("a.row", F.coalesce("b.spans", none).alias("spans"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, spans)``, one row per input row, ``spans`` an array of ``(start, kind, end)``.

    Kinds are numbered as in KINDS, disclosing terms after them. Defined cases: null text counts as empty; repeated rows each
    get their row; rows that share a doc_id are judged by their own text; an empty table gives no rows; other columns are ignored.
    """
    return _with_spans(docs.select("doc_id", "text")).select("row.doc_id", "spans")


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with each span generalised to its kind in brackets (spans that overlap become one), and ``n_chars`` brought up to date.

    Defined cases: as :func:`find_personal_data`; null text stays null; all other columns stay as they are, whatever their names.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(F.element_at(_names(), s["kind"] + 1)), F.lit("]"))
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), label)
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(piece))).alias("parts"))

    done = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    changed = F.when(F.size("spans") == 0, text).otherwise(done)
    rows = _with_spans(docs).select("row", "spans", changed.alias("changed"))
    made = {"text": F.col("changed")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("changed")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def _names() -> Column:
    return F.array(*(F.lit(n) for n in [*KINDS, TERM]))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(_names(), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def op9_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    counts = [_count("spans", n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
