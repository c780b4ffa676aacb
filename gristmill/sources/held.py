"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a held table may be broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, deleted when the driver's JVM ends.

    Where that is unset, a local session (tests) gets a temporary folder, and any other
    session writes beside its warehouse.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.conf.get("spark.master", "").startswith("local["):
        top = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    top = top or f"{spark.conf.get('spark.sql.warehouse.dir')}/gristmill"
    path = f"{top.rstrip('/')}/gristmill-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def hold(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: what follows is planned anew, and a lost executor costs nothing of it.

    Files of ids and few values are some hundred times smaller than their rows, so by its size a table of
    millions would be broadcast by way of the driver; one of more than ``BROADCAST_ROWS`` asks for a merge join.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if out.count() > BROADCAST_ROWS else out


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast, or for a merge join if it has more than ``BROADCAST_ROWS``.

    Rows made in Python have no size that the planner knows, so it would broadcast the other side, however many rows its files hold.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to every core: a table of many short rows may be one small file, which one task would read and parse.

    The number is given, so that small partitions are not put together again.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
