"""What the corpus operators share: table access, checkpoints and the two word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure_jobs.functions.durable import checkpointed, shared_folder, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed_row(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` with all its columns in one struct ``row`` beside ``more``: whatever their names, they clash with nothing; ``row.*`` gives them back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(name) for name, c in more.items()))


def ascii_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in UTF-8 (``bytes.split`` cuts at just those six characters)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def crc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; what decides which rows are held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % modulus
