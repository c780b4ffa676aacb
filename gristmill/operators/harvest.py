"""Keys of per-row JSON maps: parsing, exploding, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def parse_map(cell: Column, closed: bool = False) -> Column:
    """A JSON object as ``map<string,string>``: as it is, else with ``'`` read as ``"``, else empty.  ``closed``: it must end in ``}``."""
    s = strip(cell)
    options = {"allowSingleQuotes": "false"}
    read = lambda x: F.from_json(x, "map<string,string>", options)
    ok = F.startswith(s, F.lit("{")) & (F.endswith(s, F.lit("}")) if closed else F.lit(True))
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(ok, F.coalesce(read(s), read(F.replace(s, F.lit("'"), F.lit('"'))))), empty)


def explode_map(df: DataFrame, cell: str, order: str, closed: bool = False) -> DataFrame:
    """``(row_id, pos, key, value)``: a row a pair, keys stripped, blank keys gone."""
    pairs = df.select(F.col(order).alias("row_id"), F.posexplode(F.map_entries(parse_map(F.col(cell), closed))).alias("pos", "e"))
    return pairs.select("row_id", "pos", strip(F.col("e.key")).alias("key"), F.col("e.value").alias("value")).where("key != ''")


def harvest_keys(df: DataFrame, cell: str, order: str) -> DataFrame:
    """``(key, count, example, first_row, first_pos)``: occurrences of each key and its first value that says something.

    Counts and examples combine before the shuffle, whose size follows the number of distinct keys.
    Sort by ``count`` descending, ``first_row``, ``first_pos`` for the report order.
    """
    long = explode_map(df, cell, order)
    told = F.col("value").isNotNull() & ~F.col("value").isin("", "nan", "NaN")
    at = F.struct("row_id", "pos")
    out = long.groupBy("key").agg(F.count("*").alias("count"), F.min_by(F.when(told, F.col("value")), F.struct(~told, at)).alias("example"), F.min(at).alias("first"))
    return out.select("key", "count", F.coalesce("example", F.lit("")).alias("example"), F.col("first.row_id").alias("first_row"), F.col("first.pos").alias("first_pos"))
