"""The numeric matrix of a catalog, long and wide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, strip
from ..functions.values import classify, to_canonical
from ..sources.held import small
from .harvest import parse_map


def numeric_schema(fields: DataFrame) -> DataFrame:
    """``(ord, field_id, family)`` of numeric fields."""
    return fields.where("id is not null and id != '' and type = 'numeric'").select("ord", F.col("id").alias("field_id"), F.col("unit_family").alias("family"))


def spec_pairs(df: DataFrame, order: str = "row_id", specs_col: str | None = "specs") -> DataFrame:
    """``(row_id, pos, key, value)``: the JSON cell's pairs, then ``spec_*`` columns whose name the cell lacks."""
    own = parse_map(df[f"`{specs_col}`"], closed=True) if specs_col and specs_col in df.columns else F.create_map().cast("map<string,string>")
    cols = [c for c in df.columns if c.lower().startswith("spec_")]
    pair = lambda k, v: F.struct(strip(k).alias("key"), strip(F.coalesce(v, F.lit(""))).alias("value"))
    held = F.transform(F.map_entries(own), lambda e: pair(e["key"], e["value"]))
    more = F.array(*[pair(F.lit(c), df[f"`{c}`"].cast("string")) for c in cols]) if cols else F.array().cast("array<struct<key:string,value:string>>")
    new = F.filter(more, lambda e: ~F.exists(held, lambda x: x["key"] == e["key"]))
    both = F.filter(F.concat(held, new), lambda e: (e["key"] != "") & (e["value"] != "") & ~F.lower(e["key"]).isin("price_jsonld", "currency_jsonld"))
    return df.select(df[f"`{order}`"].alias("row_id"), F.posexplode(both).alias("pos", "e")).select("row_id", "pos", "e.key", "e.value")


def key_fields(aliases: DataFrame, schema: DataFrame) -> DataFrame:
    """``(norm, field_id)``: folded alias texts, of equal ones the last by ``ord``, then folded ids that no alias covers.

    ``aliases (ord, text, field_id)``.
    """
    by_alias = aliases.groupBy(fold(F.col("text")).alias("norm")).agg(F.max_by("field_id", "ord").alias("field_id"))
    by_id = schema.groupBy(fold(F.col("field_id")).alias("norm")).agg(F.min_by("field_id", "ord").alias("field_id"))
    return by_alias.unionByName(by_id.join(by_alias.select("norm"), "norm", "left_anti"))


def numeric_long(pairs: DataFrame, keys: DataFrame, schema: DataFrame, literal: bool = False) -> DataFrame:
    """``(row_id, field_id, value float)``: the last accepted value of each row and field, in its family's unit.

    Keys and schema are as many as distinct attribute names; they are broadcast unless there are
    very many, and pairs never are.  The final aggregation combines per row before its shuffle.
    """
    cells = pairs.withColumn("norm", fold(F.col("key"))).join(small(keys.join(schema.select("field_id", "family"), "field_id")), "norm")

    def read(c):
        fits = (c["kind"] == "scalar") & ((c["family"] == F.col("family")) | F.col("family").isNull() | (c["unit"] == ""))
        return F.when(fits, to_canonical(F.col("family"), c["value"], c["unit"]).cast("float"))

    # a generator: as a plain column and filter the classification would be run again below the joins
    read_one = F.get(F.transform(F.array(classify(F.col("value"), literal)), read), F.lit(0))
    good = cells.select("row_id", "pos", "field_id", F.explode_outer(F.array(read_one)).alias("value")).where("value is not null")
    return good.groupBy("row_id", "field_id").agg(F.max_by("value", "pos").alias("value"))


def numeric_wide(long: DataFrame, field_ids: list[str]) -> DataFrame:
    """One column a field, null where the row has no value."""
    return long.groupBy("row_id").pivot("field_id", field_ids).agg(F.first("value"))
