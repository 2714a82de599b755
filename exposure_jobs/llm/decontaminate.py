"""Benchmark decontamination with a positional inverted index; DataFrame operations only.

Test windows meet the corpus through the postings of their two rarest terms: posting lists, moved by the terms' places in the item,
are intersected to alignments of item and document, once for all windows of the item, and only windows whose two terms an alignment
has are compared word by word. Common words never get postings. The same index answers proximity: an item's rarest terms, in any
order, within a short stretch of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure_jobs.llm.common import checkpointed, packed_row, table

WINDOW = 10
#: A side is broadcast only if it was counted and has no more rows, and no more bytes in its strings, than this.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 1 << 25
#: Proximity: so many of an item's rarest terms within a stretch of so many words.
NEAR_TERMS, NEAR_SPAN = 3, 30
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_remove(F.split(F.translate(column, _UPPER, _LOWER), _GAP), "")


def bounded(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if its counted rows and bytes allow it, else as it is: then the join shuffles both sides."""
    length = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c, t in side.dtypes if t == "string"), F.lit(0))
    size = side.agg(F.count("*").alias("rows"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    return F.broadcast(side) if size["rows"] <= rows and size["bytes"] <= BROADCAST_BYTES else side


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a second key of the text, so that rows that share a doc_id stay apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``items(item_id, text)`` → ``(item, ik, s, win, len)``: each window of ``width`` words, or the one of all words of a shorter item.

    ``ik`` names the item's words and ``s`` the window's place in them; ``item`` is the id as a string, the empty one for null.
    """
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w")).filter(F.size("w") > 0)
    starts = cut.select("item", "w", F.xxhash64("w").alias("ik"), F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))).alias("s"))
    windows = starts.select("item", "ik", (F.col("s") - 1).alias("s"), F.slice("w", F.col("s"), width).alias("w"))
    return windows.select("item", "ik", "s", F.concat_ws(" ", "w").alias("win"), F.size("w").alias("len")).distinct()


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "th", F.posexplode(words("text")).alias("pos", "term"))


def rarity(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, cf)``: how often each of ``terms(term)`` stands in the whole corpus; terms that don't are missing."""
    return docs.select(F.explode(words("text")).alias("term")).join(bounded(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("cf"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index ``(term, doc_id, th, pos)`` for ``terms(term)`` over all documents."""
    return _tokens(docs).join(bounded(terms), "term", "left_semi").select("term", "doc_id", "th", "pos")


def rarest_terms(windows: DataFrame, counted: DataFrame) -> DataFrame:
    """``(ik, s, win, len, p1, t1, p2, t2)``: each window with its two rarest terms and their places in the item (the second null in
    windows of one word). Windows with a term that no document has can't occur and are left out."""
    terms = windows.select("ik", "s", "win", "len", F.posexplode(F.split("win", " ")).alias("off", "term"))
    ranked = terms.join(counted, "term", "left").groupBy("ik", "s", "win", "len").agg(  # at most the width of a window
        F.sort_array(F.collect_list(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), (F.col("s") + F.col("off")).alias("p"), F.col("term").alias("t")))).alias("r")
    )
    return ranked.filter(F.col("r")[0]["cf"] > 0).select("ik", "s", "win", "len", *(F.get("r", F.lit(n))[c].alias(f"{c}{n + 1}") for n in (0, 1) for c in ("p", "t")))


def window_matches(docs: DataFrame, rarest: DataFrame, index: DataFrame) -> DataFrame:
    """All occurrences ``(doc_id, th, start, win, len)`` of the windows ``rarest`` in ``docs(doc_id, th, text)``, by their postings ``index``."""
    anchors = rarest.select("ik", F.col("p1").alias("p"), F.col("t1").alias("term")).union(rarest.filter("p2 IS NOT NULL").select("ik", "p2", "t2")).distinct()
    placed = index.join(bounded(anchors), "term")
    aligned = placed.groupBy("ik", "doc_id", "th", (F.col("pos") - F.col("p")).alias("shift")).agg(F.collect_set("p").alias("met"))  # bounded by the item's length
    short = bounded(rarest.filter("len = 1").select("ik").distinct())
    likely = aligned.filter(F.size("met") > 1).union(aligned.filter(F.size("met") == 1).join(short, "ik", "left_semi"))
    met = likely.join(bounded(rarest), "ik").filter(F.array_contains("met", F.col("p1")) & (F.col("p2").isNull() | F.array_contains("met", F.col("p2"))))
    candidates = met.select("doc_id", "th", (F.col("s") + F.col("shift")).alias("start"), "win", "len").filter("start >= 0").distinct()
    return _confirmed(docs, checkpointed(candidates, few=True))


def _confirmed(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates whose words are the window's, looked up in the documents they name."""
    places = candidates.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "win", "len")).alias("c"))  # bounded by a document's own length
    ids = bounded(candidates.select(F.col("doc_id").alias("i"), F.col("th").alias("h")).distinct())
    named = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left_semi").dropDuplicates(["doc_id", "th"])
    named = named.select(F.col("doc_id").alias("i"), F.col("th").alias("h"), words("text").alias("w"))
    met = named.join(places, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")))
    right = F.filter("c", lambda c: F.concat_ws(" ", F.slice(F.col("w"), c["start"] + 1, c["len"])) == c["win"])
    return met.select("doc_id", "th", F.explode(right).alias("m")).select("doc_id", "th", "m.start", "m.win", "m.len")


def proximate(index: DataFrame, picked: DataFrame, span: int = NEAR_SPAN) -> DataFrame:
    """``(doc_id, th, item, width)``: documents where all ``picked(item, ik, term, rank, many)`` of an item stand within ``span`` words,
    and the least such width."""
    places = index.join(bounded(picked), "term")
    before = Window.partitionBy("ik", "doc_id", "th").orderBy("pos")  # one item's rarest terms in one document
    last = [F.max(F.when(F.col("rank") == k, F.col("pos"))).over(before) for k in range(1, NEAR_TERMS + 1)]
    seen = places.select("doc_id", "th", "ik", "item", "pos", "many", F.filter(F.array(*last), lambda p: p.isNotNull()).alias("last"))
    width = seen.filter(F.size("last") == F.col("many")).select("doc_id", "th", "item", (F.col("pos") - F.array_min("last") + 1).alias("width"))
    return width.filter(F.col("width") <= span).groupBy("doc_id", "th", "item").agg(F.min("width").alias("width"))


def _picked(items: DataFrame, counted: DataFrame) -> DataFrame:
    """The NEAR_TERMS rarest terms of each item, ``(item, ik, term, rank, many)``; ``ik`` names the row's id and words."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w")).filter(F.size("w") > 0).distinct()
    own = named.select("item", F.xxhash64("item", "w").alias("ik"), F.explode(F.array_distinct("w")).alias("term"))
    own = own.join(counted, "term", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    order = F.row_number().over(Window.partitionBy("ik").orderBy("cf", "term"))
    return own.withColumn("rank", order).filter(F.col("rank") <= NEAR_TERMS).withColumn("many", F.count("*").over(Window.partitionBy("ik"))).select("item", "ik", "term", "rank", "many")


def _indexed(docs: DataFrame, items: DataFrame, near: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The items' windows, their rarest terms, the terms of proximity (none unless ``near``), and one index for both."""
    windows = checkpointed(item_windows(items), few=True)
    counted = checkpointed(rarity(docs, windows.select(F.explode(F.split("win", " ")).alias("term")).distinct()), few=True)
    rarest = checkpointed(rarest_terms(windows.select("ik", "s", "win", "len").distinct(), counted), few=True)
    picked = checkpointed(_picked(items, counted) if near else _picked(items.limit(0), counted), few=True)
    terms = rarest.select(F.col("t1").alias("term")).union(rarest.filter("t2 IS NOT NULL").select("t2")).union(picked.select("term")).distinct()
    return windows, rarest, picked, checkpointed(postings(docs, terms))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items, contaminated, near``.

    ``items`` are those with occurring windows, ``near`` those whose NEAR_TERMS rarest terms stand within NEAR_SPAN words; both
    sorted as strings. Defined cases: null text has no words and no hits; null or empty items have no windows; an item with a null
    id counts as the empty string; repeated rows each get their row (and count each in the terms' rarity); rows that share a doc_id
    are judged by their own text; items with fewer terms than NEAR_TERMS use all they have, and one with a term that no document has
    is near nothing; empty tables give no rows or no hits; other columns are ignored.
    """
    docs = keyed(docs)
    windows, rarest, picked, index = _indexed(docs, items, near=True)
    matches = checkpointed(window_matches(docs, rarest, index), few=True)
    hit = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))))
    hits = matches.groupBy("doc_id", "th").agg(hit.cast("long").alias("n_hit"))
    found = matches.select("doc_id", "th", "win").distinct().join(bounded(windows.select("win", "item").distinct()), "win").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    close = proximate(index, picked).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("near"))
    key = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))
    both = hits.alias("a").join(found.alias("b"), key("a", "b")).select("a.doc_id", "a.th", "n_hit", "items")
    counted = docs.select("doc_id", "th", F.size(words("text")).cast("long").alias("n_words"))
    joined = counted.alias("a").join(both.alias("b"), key("a", "b"), "left").select("a.doc_id", "a.th", "n_words", "n_hit", "items")
    joined = joined.alias("a").join(close.alias("b"), key("a", "b"), "left")
    none = F.array().cast("array<string>")
    result = joined.select("a.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "near")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no test window occurs, in the same columns.

    Defined cases: as :func:`contamination`; rows that share a doc_id are judged by their own text, a null text or id stays; an
    empty benchmark drops nothing; other columns stay as they are, whatever their names.
    """
    own = keyed(docs)
    _, rarest, _, index = _indexed(own, items, near=False)
    bad = checkpointed(window_matches(own, rarest, index).select(F.col("doc_id").alias("i"), F.col("th").alias("h")).distinct(), few=True)
    rows = packed_row(docs, id=F.col("doc_id"), th=F.xxhash64("text"))
    return rows.join(bounded(bad), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h")), "left_anti").select("row.*")


def proximity_matches(docs: DataFrame, items: DataFrame, span: int = NEAR_SPAN) -> DataFrame:
    """``(doc_id, item, width)``: documents where an item's NEAR_TERMS rarest terms stand within ``span`` words, and the least such width.

    Defined cases: as :func:`contamination`; rows that share a doc_id count as one document, with the least width of theirs.
    """
    docs = keyed(docs)
    _, _, picked, index = _indexed(docs, items, near=True)
    return proximate(index, picked, span).groupBy("doc_id", "item").agg(F.min("width").alias("width"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
cf AS (SELECT term, count(*) AS cf FROM tok GROUP BY term),
it AS (SELECT DISTINCT item_id::VARCHAR AS item, unnest(w) AS term FROM i WHERE len(w) > 0),
pk AS (SELECT *, count(*) OVER (PARTITION BY item) AS many FROM (SELECT it.item, it.term, row_number() OVER (PARTITION BY it.item ORDER BY coalesce(cf, 0), it.term) AS k
       FROM it LEFT JOIN cf ON it.term = cf.term) WHERE k <= 3),
pl AS (SELECT doc_id, item, p, many, max(CASE WHEN k = 1 THEN p END) OVER o AS a, max(CASE WHEN k = 2 THEN p END) OVER o AS b, max(CASE WHEN k = 3 THEN p END) OVER o AS c
       FROM tok JOIN pk ON tok.term = pk.term WINDOW o AS (PARTITION BY doc_id, item ORDER BY p)),
near AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n_near FROM pl
         WHERE (a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER = many AND p - least(coalesce(a, p), coalesce(b, p), coalesce(c, p)) < 30 GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN named ON d.doc_id = named.doc_id LEFT JOIN near ON d.doc_id = near.doc_id
"""
