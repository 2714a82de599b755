"""A trie of conversations' turn prefixes, as rows: who owns which node, chains of owned nodes, and sums over subtrees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure_jobs.llm.common import checkpointed, table
from exposure_jobs.llm.components import SALTS
from exposure_jobs.llm.resampling import _BYTE_TABLE, crc32_sql
from exposure_jobs.operators.running import running

#: A conversation takes its first turns, up to MOST_SHARED - 1 by its id, from the first conversation of its family of FAMILY ids.
FAMILY, MOST_SHARED = 20, 4
DIGEST = ["h1", "h2", "depth"]
#: Sorted ids are joined to pieces of so many before they meet in one hash.
PIECE = 512


def turn_rows(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` → ``(conv_id, k, content, n_words)``: the turns numbered from 1, texts as digests.

    Of equal turn numbers the digest decides, which is over role and text; rows without a conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.sha2(F.concat_ws(":", F.octet_length(role), role, text).cast("binary"), 256)
    slim = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", content.alias("content"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"), F.lit(1).cast("long").alias("one"))
    order = [F.col("turn").asc_nulls_first(), F.col("content")]
    return running(slim, ["conv_id"], order, {"k": ("sum", "one")}).select("conv_id", "k", "content", "n_words")


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(conv_id, k, content, n_words)`` → the rebuilt conversations in the same form, and ``(conv_id, length)`` of each, 0 too."""
    lengths = checkpointed(rows.groupBy("conv_id").agg(F.max("k").alias("own")), few=True)
    heads = rows.filter(F.col("k") < MOST_SHARED).filter(F.col("conv_id") % FAMILY == 0)
    told = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    told = told.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    told = checkpointed(told.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), few=True)
    first = told.select("conv_id", "base", "taken").join(heads.withColumnRenamed("conv_id", "base"), "base").filter(F.col("k") <= F.col("taken"))
    later = rows.join(told.select("conv_id", "h", "taken"), "conv_id").filter(F.col("k") > F.col("h"))
    made = first.select("conv_id", "k", "content", "n_words").union(later.select("conv_id", (F.col("k") - F.col("h") + F.col("taken")).alias("k"), "content", "n_words"))
    return made, told.select("conv_id", "length")


def prefix_digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, depth, h1, h2, n_words)``: a rolling 128-bit hash of each conversation's first ``depth`` turns, and the words of the last.

    A turn's hash covers its place, so the xor of the first ones tells their sequence.
    """
    hashed = rows.select("conv_id", F.col("k").alias("depth"), "n_words", *(F.xxhash64(F.lit(seed), "k", "content").alias(f"x{seed}") for seed in (1, 2)))
    return running(hashed, ["conv_id"], ["depth"], {"h1": ("xor", "x1"), "h2": ("xor", "x2")}).select("conv_id", "depth", "h1", "h2", "n_words")


def looked_up(rows: DataFrame, keys: list[str], found: DataFrame, by: str) -> DataFrame:
    """``rows`` left-joined with ``found``, unique by ``keys``, however many rows share a key: key and salt meet ``found`` first, once
    each, and rows get the answer by key and salt."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return salted.join(salted.select(*keys, "salt").distinct().join(found, keys), [*keys, "salt"], "left").drop("salt")


def first_owned_depths(lengths: DataFrame, owned: DataFrame, longest: int) -> DataFrame:
    """``(conv_id, first, length)`` for conversations that own a node, by binary search.

    A conversation is the least of all that start with its first d turns from some d on, for fewer turns are shared by more. Each round
    asks for the middle depths of all conversations in one join with the owners, which no key can make uneven.
    """
    state = lengths.select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high"))  # low <= first <= high
    asked = owned.select(F.col("conv_id"), F.col("depth").alias("mid"), F.lit(True).alias("own"))
    for _ in range(longest.bit_length() + 1):
        middle = state.withColumn("mid", F.floor((F.col("low") + F.col("high")) / 2))
        open_ = F.col("low") < F.col("high")
        answered = middle.join(asked, ["conv_id", "mid"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
        high = F.when(open_ & F.col("own"), F.col("mid")).otherwise(F.col("high"))
        low = F.when(open_ & ~F.col("own"), F.col("mid") + 1).otherwise(F.col("low"))
        state = checkpointed(answered.select("conv_id", "length", low.alias("low"), high.alias("high")), few=True)
    return state.filter("low <= length").select("conv_id", F.col("low").alias("first"), "length")


def subtree_sums(chains: DataFrame, values: list[str]) -> DataFrame:
    """``chains(conv_id, parent_conv, *values)`` → ``(conv_id, *values)``, each with those of all chains below it added.

    Every round doubles how far up a chain sends what it has gathered, so rounds grow with the logarithm of the nesting.
    """
    state = checkpointed(chains.select("conv_id", F.col("parent_conv").alias("up"), *values), few=True)
    while not state.filter("up IS NOT NULL").isEmpty():
        sent = state.filter("up IS NOT NULL").groupBy("up").agg(*(F.sum(v).alias(f"s_{v}") for v in values))
        added = state.join(sent.withColumnRenamed("up", "conv_id"), "conv_id", "left")
        above = state.filter("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        sums = [(F.col(v) + F.coalesce(f"s_{v}", F.lit(0))).alias(v) for v in values]
        state = checkpointed(looked_up(added.select("conv_id", "up", *sums), ["up"], above, "conv_id").select("conv_id", F.col("next").alias("up"), *values), few=True)
    return state.select("conv_id", *values)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``ends(node, depth, conv_id)`` → ``(node, depth, ends_sha256)``: SHA-256 over the ascending ids of a node, comma-joined.

    Ids are sorted in ranges and joined to pieces there; a hash, which can only be fed in order, then takes a node's pieces one after the
    other, so that a node with very many ids holds none of them in memory.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, at = [], None
            for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (node, depth) or len(made[-1][3]) >= PIECE:
                    made.append((node, depth, conv, []))
                    at = (node, depth)
                made[-1][3].append(str(conv))
            columns = [list(c) for c in zip(*((n, d, c, ",".join(p)) for n, d, c, p in made), strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["node", "depth", "first", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in done], pa.int64()), pa.array([r[0][1] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.string())], ["node", "depth", "ends_sha256"])

        for batch in batches:
            done = []
            for node, depth, piece in zip(batch["node"].to_pylist(), batch["depth"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if at != (node, depth):
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = (node, depth), hashlib.sha256(piece.encode())
                else:
                    digest.update(f",{piece}".encode())
            yield rows(done)
        if at is not None:
            yield rows([(at, digest.hexdigest())])

    ids = ends.select(*(F.col(c).cast("long").alias(c) for c in ("node", "depth", "conv_id")))
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.repartitionByRange(parts, "node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id")
    joined = ranged.mapInArrow(pieces, "node long, depth long, first long, piece string")
    met = joined.repartition(parts, "node", "depth").sortWithinPartitions("node", "depth", "first")
    return met.mapInArrow(hashed, "node long, depth long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text, ...)`` → one row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    A node belongs to the least conversation that starts with it; a conversation's own nodes are a chain, from the first depth it owns to
    its end. Chains hang on nodes of other chains and are summed up along that tree, then along each chain from its end.

    Defined cases: turns are numbered by turn, nulls first, equal ones by the digest of role and text; null role and text are empty;
    repeated rows are turns of their own; rows without a conv_id are left out; an empty table gives no rows (there is no root without a
    conversation); other columns are ignored.
    """
    rows, lengths = rebuilt(turn_rows(turns))
    prefixes = prefix_digests(rows)
    prefixes = checkpointed(prefixes)
    minima = checkpointed(prefixes.groupBy(*DIGEST).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words")))
    totals = lengths.agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("longest"), F.count("*").alias("n_convs")).first()
    if not totals["n_convs"]:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    least = F.lit(totals["conv_id"]).cast("long")
    owners = first_owned_depths(lengths, minima.select("conv_id", "depth"), int(totals["longest"]))
    # where each chain hangs: the node before its first, which is another's; the root (depth 0) is the least conversation's
    hung = prefixes.join(owners.filter("first > 1").select("conv_id", (F.col("first") - 1).alias("depth")), ["conv_id", "depth"])
    hung = looked_up(hung, DIGEST, minima.select(*DIGEST, F.col("conv_id").alias("parent")), "conv_id").select("conv_id", "parent")
    chains = owners.join(hung, "conv_id", "left").withColumn("parent", F.coalesce("parent", F.when(F.col("first") == 1, least)))
    chains = checkpointed(chains.select("conv_id", "first", "length", (F.col("first") - 1).alias("at"), F.when(F.col("parent") != F.col("conv_id"), F.col("parent")).alias("parent_conv")), few=True)
    # the root goes on in the least conversation's own chain, if that has any turns
    hanging = chains.filter("parent_conv IS NOT NULL").groupBy(F.col("parent_conv").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hanging"))
    root = turns.sparkSession.range(1).select(least.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(totals["n_convs"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("n_words"))
    nodes = minima.select("conv_id", "depth", "n_convs", "n_words").union(root).join(lengths, "conv_id").join(hanging, ["conv_id", "depth"], "left")
    children = F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("length")).cast("int")
    nodes = nodes.select("conv_id", "depth", "n_convs", children.cast("long").alias("n_children"), (children == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    nodes = checkpointed(nodes)
    own = nodes.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    heads = chains.select("conv_id", "parent_conv", "first", "at")
    below = subtree_sums(own.join(heads.select("conv_id", "parent_conv"), "conv_id", "left"), ["leaves", "saved"])
    sent = below.join(heads.filter("parent_conv IS NOT NULL"), "conv_id").groupBy(F.col("parent_conv").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    full = checkpointed(nodes.join(sent, ["conv_id", "depth"], "left").withColumns({v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in ("leaves", "saved")}).drop("more_leaves", "more_saved"))
    summed = running(full, ["conv_id"], [F.col("depth").desc()], {"n_leaves": ("sum", "leaves"), "saved_tokens": ("sum", "saved")})
    ends = prefixes.join(lengths.filter("length > 0").withColumnRenamed("length", "depth"), ["conv_id", "depth"])
    ends = looked_up(ends, DIGEST, minima.select(*DIGEST, F.col("conv_id").alias("node")), "conv_id").select("node", "depth", "conv_id")
    ends = ends.union(lengths.filter("length = 0").select(least.alias("node"), F.lit(0).cast("long"), "conv_id"))
    digests = ends_digests(ends).withColumnRenamed("node", "conv_id")
    placed = summed.join(heads.select("conv_id", "parent_conv", "first"), "conv_id", "left").join(digests, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") == 0, None).when((F.col("depth") == F.col("first")) & F.col("parent_conv").isNotNull(), F.col("parent_conv")).otherwise(F.col("conv_id"))
    return placed.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = rf"""
WITH {_BYTE_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(c)) AS k, c, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n_words
      FROM (SELECT conv_id, turn, coalesce(text, '') AS x, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || ':' || coalesce(text, '') AS c FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % {MOST_SHARED} AS h, count(*) AS own FROM t, crc GROUP BY ALL),
told AS (SELECT ids.conv_id, ids.h, ids.conv_id - ids.conv_id % {FAMILY} AS base, least(ids.h, coalesce(b.own, 0)) AS taken FROM ids LEFT JOIN ids b ON b.conv_id = ids.conv_id - ids.conv_id % {FAMILY}),
r AS (SELECT told.conv_id, k AS d, c, n_words FROM told JOIN t ON t.conv_id = told.base AND k <= taken
      UNION ALL SELECT told.conv_id, k - h + taken, c, n_words FROM told JOIN t ON t.conv_id = told.conv_id AND k > h),
p AS (SELECT conv_id, d, n_words, sha256(string_agg(sha256(c), ',') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS x, count(*) OVER (PARTITION BY conv_id) AS len FROM r
      UNION ALL SELECT ids.conv_id, 0, 0, '', (SELECT count(*) FROM r WHERE r.conv_id = ids.conv_id) FROM ids),
l AS (SELECT p.*, lag(x) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM p),
n AS (SELECT x, d, min(conv_id) AS c, count(*) AS n_convs, max(n_words) AS w, any_value(up) AS up, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len), '')) AS ends FROM l GROUP BY x, d),
kids AS (SELECT up AS x, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT a.x, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n_convs - 1) * n.w) AS saved FROM n JOIN p a ON a.conv_id = n.c AND a.d <= n.d LEFT JOIN kids ON kids.x = n.x GROUP BY a.x)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, u.c AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n u ON u.x = n.up LEFT JOIN kids ON kids.x = n.x JOIN s ON s.x = n.x
"""
