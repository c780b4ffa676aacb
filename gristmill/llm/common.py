"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which driver and executors share; it goes when the driver's JVM ends.

    Where that is unset, a local session (tests) gets a temporary folder, and any other
    session writes beside its warehouse.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.conf.get("spark.master", "").startswith("local["):
        top = tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", top)
    top = top or f"{spark.conf.get('spark.sql.warehouse.dir')}/gristmill-cuts"
    path = f"{top.rstrip('/')}/gristmill-{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends, and lost executors cost nothing."""
    return cut_at(df)[0]


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut_counted(df: DataFrame, *more: Column) -> tuple[DataFrame, str, dict]:
    """``cut_at``, with ``rows`` and further aggregates that are gathered while the table is written."""
    seen = Observation()
    held, path = cut_at(df.observe(seen, F.count(F.lit(1)).alias("rows"), *more))
    return held, path, seen.get


def few_tasks(df: DataFrame, rows: int, each: int = 100_000, least: int = 12) -> DataFrame:
    """``df``, whose last stage reads a shuffle, in no more tasks than ``rows`` rows need."""
    n = max(least, -(-rows // each))
    return df.coalesce(n) if n < parts_of(df.sparkSession) else df


def salted_join(rows: DataFrame, few: DataFrame, on: list[str], key: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """``rows`` joined with ``few``, which has a row for each value of ``on`` and is small beside it.

    The rows of one value are dealt to ``salts`` tasks by ``key``, and each row of ``few`` goes to all of them.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), key), F.lit(salts)))
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(few, [*on, "salt"], how).drop("salt")


def drop_cut(spark: SparkSession, path: str) -> None:
    """Delete a table that ``cut_at`` wrote and that nothing will read again."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def n_words(text: Column) -> Column:
    """Words of a text (``[^\\x20\\x09-\\x0D]+``); null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
