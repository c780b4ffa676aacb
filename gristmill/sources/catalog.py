"""Readers: catalogs, key lists, JSON documents, JSON lines, vectors, numeric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = "keys array<string>"


def read_catalog(spark: SparkSession, path: str, required: str | None = None, typed: bool = False, max_rows: int = 0) -> DataFrame:
    """A CSV with header and quoted line breaks; strings with null as ``""`` unless ``typed``.

    ``row_id`` follows file order: input splits are taken in order, so ids rise along the file
    (with gaps between splits of multi-file inputs).  ``max_rows`` keeps the first rows.
    """
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=typed)
    if required and required not in df.columns:
        raise ValueError(f"column {required!r} is missing from {path}; it has {df.columns}")
    if not typed:
        df = df.na.fill("")
    df = df.withColumn("row_id", F.monotonically_increasing_id())
    return df.orderBy("row_id").limit(max_rows) if max_rows > 0 else df


def read_raw_keys(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, key, count, example)`` of ``{"keys": [...]}``; items without a key go, counts default to 0, examples to ``""``."""
    items = spark.read.text(path, wholetext=True).select(F.from_json("value", "keys array<struct<key:string,count:string,example:string>>").alias("d")).select(F.posexplode("d.keys").alias("ord", "i"))
    return items.where("i.key is not null").select("ord", "i.key", F.coalesce(F.col("i.count").try_cast("long"), F.lit(0)).alias("count"), F.coalesce("i.example", F.lit("")).alias("example"))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, id, label, type, unit_family, count, example, aliases)`` of a fields document."""
    shape = "fields array<struct<id:string,label:string,type:string,unit_family:string,count:bigint,example:string,aliases:array<struct<text:string,count:bigint,confidence:double>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("d"))
    return doc.select(F.posexplode("d.fields").alias("ord", "f")).select("ord", "f.*")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, text, field_id)`` of an alias document."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "aliases map<string,string>").alias("d"))
    return doc.select(F.posexplode("d.aliases").alias("ord", "text", "field_id"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file in ``schema``; a blank line or one that can't be read is a row of nulls, so that places stay aligned."""
    lines = spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id())
    return lines.select("row_id", F.from_json("value", schema).alias("r")).select("row_id", "r.*")


def read_vectors(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """``(row_id, channel, vec)``; with ``rows``, each of its ids must have a vector in every channel, and no other."""
    v = spark.read.parquet(path)
    if rows is not None:
        per = v.groupBy("channel").agg(F.count("*").alias("n"))
        odd = v.join(rows.select("row_id"), "row_id", "left_anti").limit(1).count()
        n = rows.count()
        if odd or per.where(F.col("n") != n).limit(1).count():
            raise ValueError(f"vectors in {path} don't match the {n} rows")
    return v


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def require_paths(spark: SparkSession, paths: list[str]) -> None:
    """Raise unless each path exists in its own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    missing = [p for p, x in at if not x.getFileSystem(conf).exists(x)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {missing}")
