"""Sets of tables that belong together: written side by side under a version, and visible only once one pointer row names them."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposure_jobs.sources.alerts import read_by_region, write_by_region

POINTER = "number long, version string, at string, tables array<string>, facts map<string,string>"


def publish(root: str, tables: dict[str, DataFrame], facts: dict[str, str], by_region: bool = True) -> str:
    """Writes ``tables`` into a folder of their own and then adds one pointer row that names the version, its tables and ``facts``.

    A crash before the pointer leaves the version before in force: nobody reads what no pointer names. One publisher at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    before = pointers(spark, root)
    number = 1 + (before.agg(F.max("number")).first()[0] or 0)
    version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        path = f"{root}/versions/{version}/{name}"
        if by_region and "region_id" in df.columns:
            write_by_region(df, path)
        else:
            df.write.parquet(path)
    row = (number, version, datetime.now(timezone.utc).isoformat(), sorted(tables), {k: str(v) for k, v in facts.items()})
    spark.createDataFrame([row], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return version


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """All pointer rows; none where nothing was published."""
    try:
        return spark.read.schema(POINTER).parquet(f"{root}/pointers")
    except AnalysisException:
        return spark.createDataFrame([], POINTER)


def current(spark: SparkSession, root: str) -> dict:
    """The last pointer row as a dictionary; an error where nothing was published."""
    row = pointers(spark, root).orderBy(F.col("number").desc(), F.col("version").desc()).first()
    if row is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return row.asDict()


def read_published(spark: SparkSession, root: str, name: str, regions: list[str] | None = None, **facts: str) -> DataFrame:
    """A table of the version in force. Facts that are asked for must be those of the version; a table or region it lacks is an error."""
    pointer = current(spark, root)
    if name not in pointer["tables"]:
        raise FileNotFoundError(f"{pointer['version']} has no {name}")
    if wrong := {k: (pointer["facts"].get(k), str(v)) for k, v in facts.items() if pointer["facts"].get(k) != str(v)}:
        raise ValueError(f"{pointer['version']} does not fit: {wrong}")
    path = f"{root}/versions/{pointer['version']}/{name}"
    return read_by_region(spark, path, regions) if regions is not None else spark.read.parquet(path)
