"""The region registry: which areas are forecast, how they roll up and how far back the model is trained."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Region, display name, name in the raw feed, roll-up, left out, months of primary training (of 30 days).
REGISTRY = [
    ("kyiv_city", "Kyiv City", "Kyiv City", "none", False, 18),
    ("kyivska_oblast", "Kyivska oblast", "Kyivska oblast", "oblast", False, 12),
    ("kharkivska_oblast", "Kharkivska oblast", "Kharkivska oblast", "oblast", False, 12),
    ("lvivska_oblast", "Lvivska oblast", "Lvivska oblast", "oblast", False, 24),
    ("dnipropetrovska_oblast", "Dnipropetrovska oblast", "Dnipropetrovska oblast", "oblast", False, 12),
    ("odeska_oblast", "Odeska oblast", "Odeska oblast", "oblast", False, 18),
    ("sumska_oblast", "Sumska oblast", "Sumska oblast", "oblast", False, 12),
    ("luhanska_oblast", "Luhanska oblast", "Luhanska oblast", "oblast", True, None),
]
REGISTRY_SCHEMA = "region_id string, display_name string, oblast string, rollup string, excluded boolean, primary_train_days int"


def registry(spark: SparkSession, rows: list | None = None) -> DataFrame:
    made = [(*r[:5], None if r[5] is None else 30 * r[5]) for r in (REGISTRY if rows is None else rows)]
    return spark.createDataFrame(made, REGISTRY_SCHEMA)


def allowlisted() -> list[str]:
    return [r[0] for r in REGISTRY if not r[4]]


def check_regions(asked: list[str]) -> list[str]:
    """The asked ids, or an error for one that is unknown or left out."""
    known = {r[0]: r[4] for r in REGISTRY}
    for region in asked:
        if region not in known:
            raise KeyError(f"unknown region {region!r}")
        if known[region]:
            raise ValueError(f"region {region!r} is left out")
    return list(asked)


def attach_region(events: DataFrame, regions: DataFrame) -> DataFrame:
    """Events of registered regions, with ``region_id``; others drop out. The registry is a code-declared handful of rows."""
    return events.drop("region_id").join(F.broadcast(regions.filter(~F.col("excluded")).select("region_id", "oblast")), "oblast")


def unmapped(events: DataFrame, regions: DataFrame) -> DataFrame:
    """How many events of each feed name have no registered region."""
    return events.join(F.broadcast(regions.select("oblast")), "oblast", "left_anti").groupBy("oblast").agg(F.count("*").alias("n_events"))


@F.pandas_udf(StringType())
def ascii_fold(names: pd.Series) -> pd.Series:
    return names.map(lambda n: unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def slugify(name):
    """Display name → id: marks off, lower case, other characters to single underscores. Only the folding needs Python."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(name)), "[^a-z0-9]+", "_"), F.lit("_"))


def sub_unit(oblast, unit):
    """Id of a sub-area, ``region/unit``; the region's own id where there is no unit."""
    return F.when(F.coalesce(unit, F.lit("")) == "", slugify(oblast)).otherwise(F.concat_ws("/", slugify(oblast), slugify(unit)))
