"""A catalog from rows to answers: mine fields, build an index, search it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import HARD_FAMILIES
from ..operators import aliases as al
from ..operators import categorize, channels, embed, harvest, numeric, search
from ..sources.held import hold


@dataclass
class Mined:
    raw_keys: DataFrame
    fields: DataFrame
    report: DataFrame
    audit: DataFrame
    warnings: DataFrame
    enriched: dict[str, DataFrame]


@dataclass
class Index:
    meta: DataFrame
    vectors: DataFrame
    schema: DataFrame
    numbers: DataFrame
    aliases: DataFrame
    embedder: object

    def search(self, queries: DataFrame, options: search.SearchOptions = search.SearchOptions()) -> DataFrame:
        """Answers to ``queries (query_id, text)``."""
        both = queries.select("query_id", F.inline(F.array(F.struct(F.lit("full").alias("variant"), F.col("text").alias("t")), F.struct(F.lit("obj").alias("variant"), search.object_query(F.col("text")).alias("t")))))
        vecs = embed.embed_text(both, "t", self.embedder).select("query_id", "variant", "vec")
        return search.search(queries, vecs, self.meta, self.vectors, self.numbers, self.schema, self.aliases, options, unit=True)


def mine(catalog: DataFrame, specs_col: str = "specs", order: str = "row_id", min_support: int = 3, thread_share: float = 1.0, drop_meta: bool = True, families=HARD_FAMILIES, max_aliases: int = 5, **alias_options) -> Mined:
    """Keys, fields and aliases of a catalog.

    The tables here have a row for each distinct attribute name or alias.  Those that later
    steps read many times are written to the shared folder.
    """
    keys = hold(harvest.harvest_keys(catalog, specs_col, order))
    raw = keys.withColumn("ord", F.struct((-F.col("count")).alias("c"), "first_row", "first_pos"))
    fields = hold(categorize.build_fields(raw, min_support, thread_share, drop_meta))
    # a row for each distinct attribute name
    placed = hold(fields.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("count"), "first", "signature"))))
    enriched = al.enrich(placed, families, max_aliases=max_aliases, **alias_options)
    return Mined(keys, fields, categorize.report(fields), categorize.audit(fields), categorize.warnings(fields), {k: hold(v) if k in ("fields", "aliases") else v for k, v in enriched.items()})


def build_index(catalog: DataFrame, mined: Mined, embedder=None, specs_col: str = "specs", order: str = "row_id", literal: bool = False) -> Index:
    """Meta rows, channel vectors of length 1 and the numeric table of a catalog, each written once."""
    embedder = embedder or embed.hash_embedder()
    ch = hold(channels.build_channels(catalog, order, specs_col))
    schema = numeric.numeric_schema(mined.enriched["fields"])
    owners = mined.enriched["aliases"].join(mined.enriched["fields"].select(F.col("id").alias("field_id"), "ord"), "field_id", "left")
    keys = hold(numeric.key_fields(owners, schema))
    numbers = hold(numeric.numeric_long(numeric.spec_pairs(catalog, order, specs_col), keys, schema, literal))
    vectors = embed.channel_vectors(ch, embedder).withColumn("vec", search.unit_vector(F.col("vec")))
    return Index(hold(channels.meta_rows(ch)), hold(vectors), schema, numbers, mined.enriched["aliases"], embedder)
