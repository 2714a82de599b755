"""Quality scores from compression: which of two dictionaries, of good or of bad text, makes a document smaller?

The score is the difference of the two compressed sizes over the text's length, calibrated to a probability by a logistic fit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from exposure_jobs.llm.common import checkpointed, crc_remainder, table
from exposure_jobs.llm.linear import fit_logistic, sigmoid

#: Texts are compressed in pieces of this many bytes, so that a dictionary counts all through a long text.
PIECE = 2048
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: The documented bounds of the fit: at most so many labelled documents of each class, and of all pieces of their whole texts at most
#: so many, chosen by a hash, for the dictionary of a class (16 MB). The calibration reads the whole texts.
SAMPLE_PER_CLASS, PIECES_PER_CLASS = 2000, 8192
THRESHOLD = 0.7


def pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[at : at + PIECE] for at in range(0, len(data), PIECE)]


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[bytes, bytes]) -> list:
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(level=LEVEL) for d in dictionaries]


def size_difference(text: str | None, dictionaries: tuple[bytes, bytes]) -> float:
    """How much smaller the good dictionary makes a text than the bad one, as a share of its length; 0 for an empty text."""
    parts = pieces(text)
    good, bad = (sum(len(c.compress(p)) for p in parts) for c in _compressors(dictionaries))
    return (bad - good) / max(1, sum(map(len, parts)))


def _usable(labels: DataFrame, label: str, held_out) -> DataFrame:
    return labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).alias("y"))


def class_weights(labels: DataFrame, label: str, per_class: int, held_out) -> tuple[float, float]:
    """For how many usable labels of class 0 and of class 1 a row of ``labelled_sample`` stands, so that a fit sees the table's own ratio at every size."""
    totals = {int(r.y): r.n for r in _usable(labels, label, held_out).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return max(1.0, totals.get(0, 0) / per_class), max(1.0, totals.get(1, 0) / per_class)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held_out) -> DataFrame:
    """``(doc_id, y, text)``: at most ``per_class`` labelled documents of each class, chosen by a hash of the id, never from held-out rows.

    Ids are chosen from the labels alone, so the texts meet a list of known size. Labels of one id that differ count as 1; of
    several texts of one id the least is taken; a null id is never chosen.
    """
    usable = _usable(labels, label, held_out)
    ids = [r for y in (0, 1) for r in usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, int(r.y)) for r in ids], "doc_id long, y int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


@F.pandas_udf(ArrayType(BinaryType()))
def _pieces(texts: pd.Series) -> pd.Series:
    return texts.map(pieces, na_action=None)


def difference_column(text: str, dictionaries: tuple[bytes, bytes]):
    @F.pandas_udf(DoubleType())
    def difference(texts: pd.Series) -> pd.Series:
        return pd.Series([size_difference(t, dictionaries) for t in texts], dtype="float64")

    return difference(text)


def trained(parts: list[bytes]) -> bytes:
    """A dictionary of some text; too little text for a trained one serves as it is."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def fit(sample: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> tuple[tuple[bytes, bytes], dict]:
    """Dictionaries of good and bad text from ``sample(doc_id, y, text)``, and a calibration of the size difference to a probability.

    Pieces are cut, and differences measured, on the executors; the driver gets a bounded number of pieces and one number a
    document. ``weights`` as of ``class_weights``. An empty sample gives empty dictionaries and a constant score.
    """
    sample = checkpointed(sample, few=True)
    cut = sample.select("doc_id", "y", F.posexplode(_pieces("text")).alias("at", "piece"))
    order = F.row_number().over(Window.partitionBy("y").orderBy("rank", "doc_id", "at"))
    ranked = cut.withColumn("rank", F.xxhash64("doc_id", "at"))
    picked = ranked.withColumn("n", order).filter(F.col("n") <= PIECES_PER_CLASS).select("y", "n", "piece").collect()
    good, bad = (trained([bytes(r.piece) for r in sorted(picked, key=lambda r: r.n) if r.y == y]) for y in (1, 0))
    rows = sample.select("doc_id", "y", difference_column("text", (good, bad)).alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in rows], int)
    return (good, bad), fit_logistic(np.array([r.x for r in rows]).reshape(-1, 1), y.astype(float), weight=np.array(weights)[y])


def score(docs: DataFrame, model: tuple[tuple[bytes, bytes], dict]) -> DataFrame:
    """``docs`` → ``(doc_id, score)``; null text counts as empty, rows stay as they are, an empty table gives no rows."""
    dictionaries, calibration = model

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(np.array([size_difference(t, dictionaries) for t in texts]).reshape(-1, 1), calibration))

    return docs.select("doc_id", scored("text").alias("score"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = crc_remainder("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels")
    model = fit(labelled_sample(docs, labels, "quality", SAMPLE_PER_CLASS, out), class_weights(labels, "quality", SAMPLE_PER_CLASS, out))
    scored = score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
