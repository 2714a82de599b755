"""Quality rules as a ledger: every rule once per document, as a bit and its measurements; policies and ablations read the bits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from exposure_jobs.llm.common import packed_row, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")
_SYMBOLS, _UPPER, _LOWER = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(97, 123))

#: Rule → when it fails, over the measurements. A rule's bit is its place here; new rules go at the end, so that old ledgers stay valid.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "shouting": "n_upper + n_lower >= 50 AND 2 * n_upper > n_upper + n_lower",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
#: Policy version → the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "word_length"),
}
PRODUCTION = "v2"


def policy_mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measurements(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    spaces = len(data) - sum(map(len, words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    upper, lower, symbols = (len(data) - len(data.translate(None, kind)) for kind in (_UPPER, _LOWER, _SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_window_words(words), len(lines), upper, lower


def repeated_window_words(words: list) -> int:
    """How many words lie in a 3-word window that occurs twice or more. Windows compare by exact word numbers, not by hash."""
    if len(words) < 4:
        return 0
    numbers: dict = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    many = len(numbers)
    if many < 1 << 21:
        windows = (ids[:-2] * many + ids[1:-1]) * many + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * many + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * many + ids[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice, covered = count[which] > 1, np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


@F.pandas_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measurements(t) for t in texts], columns=list(MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, MEASURES, failed)``, ``failed`` holding a bit for each rule that the text fails.

    Defined cases: a null or blank text has no words and fails ``few_words``; repeated rows and null ids stay as they are;
    an empty table gives no rows; other columns are ignored whatever their names.
    """
    measured = docs.select("doc_id", measure("text").alias("m")).select("doc_id", "m.*")
    return measured.withColumn("failed", failed_bits())


def failed_bits() -> Column:
    """A bit for each rule that fails, over columns named as MEASURES."""
    bits = [F.when(F.expr(rule), F.lit(1 << n)).otherwise(0) for n, rule in enumerate(RULES.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int")


def passes(failed: str | Column, policy: str = PRODUCTION) -> Column:
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablations(rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    One pass over the ledger's bits; ``together`` is the OR of the bits that fail beside the rule.
    """
    names, mask = list(RULES), policy_mask(policy)
    seen = rows.select(F.col("failed").bitwiseAND(F.lit(mask)).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit")) for r in POLICIES[policy]))
    each = seen.select("f", "n", F.explode(rules).alias("r")).select("f", "n", "r.rule", "r.bit")
    fails, alone = F.col("f").bitwiseAND(F.col("bit")) != 0, F.col("f") == F.col("bit")
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when(alone | (F.col("f") == 0), F.col("n"))), F.lit(0)).alias("n_kept_without"),
        F.bit_or(F.when(fails, F.col("f").bitwiseAND(F.bitwise_not(F.col("bit")))).otherwise(0)).alias("together"),
    )


def keep_good(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The rows of ``docs`` that the policy keeps by their ledger bits, in the same columns.

    Defined cases: as :func:`ledger`; other columns stay as they are, whatever their names.
    """
    judged = packed_row(docs, m=measure("text")).select("row", "m.*").withColumn("failed", failed_bits())
    return judged.filter(passes("failed", policy)).select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    base = ~passes("failed", "base")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes("failed").alias("kept"), "failed", F.lit(PRODUCTION).alias("policy")
    )


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy costs, from the ledger of the whole table."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(ls)::BIGINT AS n_lines, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
             len(regexp_extract_all(text, '[a-z]'))::BIGINT AS n_lower FROM w),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, ws[p], ws[p + 1], ws[p + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r ON m.doc_id = r.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
             + CASE WHEN n_upper + n_lower >= 50 AND 2 * n_upper > n_upper + n_lower THEN 16 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END)::INTEGER AS failed FROM a)"""

OP8_SQL = f"""{_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed, 'v2' AS policy FROM f
"""

ABLATIONS_SQL = f"""{_LEDGER_SQL},
u AS (SELECT unnest([{", ".join(f"'{r}'" for r in POLICIES[PRODUCTION])}]) AS rule, unnest([{", ".join(str(1 << n) for n, r in enumerate(RULES) if r in POLICIES[PRODUCTION])}]) AS bit)
SELECT rule, count(*) FILTER ((failed & bit) <> 0)::BIGINT AS n_failed, count(*) FILTER (failed = bit)::BIGINT AS n_failed_alone,
       count(*) FILTER (failed = bit OR failed = 0)::BIGINT AS n_kept_without, coalesce(bit_or(failed - bit) FILTER ((failed & bit) <> 0), 0)::INTEGER AS together
FROM f, u GROUP BY rule
"""
