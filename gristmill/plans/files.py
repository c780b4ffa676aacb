"""Mined tables and indexes as files, and indexes read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalog as sources
from ..sources import sinks
from .catalog import Index, Mined

REPORT = ["id", "label", "type", "unit_family", "count", "n_samples", "n_scalar_unit", "n_scalar_unitless", "n_range", "n_dual", "n_thread", "n_unknown", "units_seen", "families_seen", "example", "decision"]
SUMMARY = ["field_id", "label", "existing_aliases", "added"]
META = "row_id long, name string, brand string, sku string, mpn string, url string, specs_col string, description string, raw_title string, raw_desc string, raw_specs string"
PARTS = ("meta.jsonl", "vectors", "numeric_specs", "numeric_schema.json", "alias_map.enriched.json")


def key_order(keys: DataFrame) -> DataFrame:
    """Keys as reports list them: by falling count, then as first seen."""
    return keys.orderBy(F.desc("count"), "first_row", "first_pos")


def field_order(fields: DataFrame) -> DataFrame:
    """Fields as reports list them: by falling count, then as first seen."""
    return fields.orderBy(F.desc("count"), "first", "signature")


def write_mined(mined: Mined, out: str, dry_run: bool = False) -> None:
    """Key lists, fields, reports and audits under ``out``; ``dry_run`` leaves out the enriched fields and the alias map.

    A row of each is a distinct attribute name or alias, so each is one file.
    """
    from ..operators import categorize

    keys = mined.raw_keys.select("key", "count", "example", "first_row", "first_pos")
    sinks.write_envelope(keys, f"{out}/raw_keys.json", "keys", [F.desc("count"), "first_row", "first_pos"])
    sinks.write_csv(key_order(keys).coalesce(1), f"{out}/raw_keys.csv", ["key", "count", "example"])
    policy = F.struct(*[F.lit(True).alias(c) for c in ("numeric_requires_all_scalar", "family_requires_unanimity", "unitless_scalar_allowed")])
    shown = mined.fields.select("id", "label", "type", "unit_family", "count", "example", "aliases", "first", "signature")
    sinks.write_envelope(shown, f"{out}/fields.semantic.json", "fields", [F.desc("count"), "first", "signature"], {"policy": policy})
    in_order = field_order(mined.fields)
    sinks.write_csv(categorize.report(in_order).coalesce(1), f"{out}/spec_key_report.csv", REPORT)
    sinks.write_json_lines(categorize.audit(in_order).coalesce(1), f"{out}/type_unit_audit.jsonl")
    sinks.write_lines(categorize.warnings(in_order).coalesce(1), f"{out}/warnings.txt")
    e = mined.enriched
    for name in ("accepted", "blocked", "collisions", "orphans"):
        sinks.write_json_lines(e[name].coalesce(1), f"{out}/audit/{name}.jsonl")
    sinks.write_csv(e["summary"].coalesce(1), f"{out}/audit/summary.csv", SUMMARY)
    if not dry_run:
        sinks.write_envelope(e["fields"], f"{out}/fields.enriched.json", "fields", ["ord"], {"source": F.struct(F.lit(True).alias("deterministic"))})
        sinks.write_alias_map(e["aliases"], f"{out}/alias_map.enriched.json")


def write_index(index: Index, out: str) -> None:
    """Meta rows, unit vectors by channel, numbers, their schema and the alias map."""
    sinks.write_json_lines(index.meta, f"{out}/meta.jsonl")
    index.vectors.write.mode("overwrite").partitionBy("channel").parquet(f"{out}/vectors")
    sinks.write_table(index.numbers, f"{out}/numeric_specs")
    pairs = F.array_sort(F.collect_list(F.struct("ord", "field_id", "family")))
    one = index.schema.agg(pairs.alias("p")).select(F.transform("p", lambda x: x["field_id"]).alias("attrs"), F.map_from_entries(F.transform("p", lambda x: F.struct(x["field_id"], x["family"]))).alias("families"))
    sinks.write_json_lines(one.coalesce(1), f"{out}/numeric_schema.json")
    sinks.write_alias_map(index.aliases, f"{out}/alias_map.enriched.json")


def read_index(spark: SparkSession, path: str, embedder) -> Index:
    """An index that ``write_index`` wrote; a part that is missing, or vectors that don't fit the rows, raise."""
    sources.require_paths(spark, [f"{path}/{p}" for p in PARTS])
    meta = spark.read.schema(META).json(f"{path}/meta.jsonl")
    schema = spark.read.schema("attrs array<string>, families map<string,string>").json(f"{path}/numeric_schema.json")
    schema = schema.select(F.posexplode("attrs").alias("ord", "field_id"), "families").select("ord", "field_id", F.try_element_at("families", F.col("field_id")).alias("family"))
    aliases = sources.read_aliases(spark, f"{path}/alias_map.enriched.json").select("text", "field_id")
    return Index(meta, sources.read_vectors(spark, f"{path}/vectors", meta), schema, sources.read_numbers(spark, f"{path}/numeric_specs"), aliases, embedder)
