"""Data cut from its lineage in files that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame, few: bool = False) -> DataFrame:
    """``df`` cut from its lineage, as files in the shared folder that outlive any executor.

    ``few`` is for small results: what all tasks computed is dealt once more, into a sixteenth of the shuffle partitions (four at
    least), so that it becomes few files while the computation keeps all its tasks.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if few:
        df = df.repartition(max(4, shuffle_partitions(df.sparkSession) // 16))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the session's shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: A side is broadcast up to so many rows, counted first; its rows are a few numbers and short names each.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, with a broadcast hint if its counted rows allow it; else the join shuffles both sides."""
    cut = checkpointed(df, few=True)
    return F.broadcast(cut) if cut.count() <= BROADCAST_ROWS else cut
