"""Text channels and meta rows of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import CHANNEL_SKIPS
from ..functions.text import human_label, let, strip
from .harvest import parse_map

CHAINS = {
    "name": ("name", "title"),
    "brand": ("brand", "spec_brand", "Brand"),
    "description": ("description", "spec_description", "spec_metadescription", "spec_ogdescription"),
    "url": ("url", "product_url"),
    "mpn": ("mpn", "spec_mpn", "spec_manufacturers-part-number", "Manufacturers Part Number"),
    "sku": ("sku", "spec_sku"),
}


def first_of(df: DataFrame, *names: str) -> Column:
    """The first text that isn't blank, stripped, of the columns that ``df`` has; else empty."""
    found = [F.nullif(strip(df[f"`{n}`"].cast("string")), F.lit("")) for n in dict.fromkeys(names) if n in df.columns]
    return F.coalesce(*found, F.lit(""))


def title_text(name: Column, brand: Column, desc: Column) -> Column:
    shown = (brand != "") & ~F.contains(F.lower(name), F.lower(brand))
    both = F.concat_ws(" — ", F.nullif(name, F.lit("")), F.when(shown, brand))
    return F.when(both != "", both).when(desc != "", F.substring(desc, 1, 80)).otherwise("(no title)")


def spec_entries(df: DataFrame, specs_col: str | None) -> Column:
    """``map<string,string>`` of the JSON cell and of ``spec_*`` columns whose name it lacks; blank and meta entries go."""
    own = parse_map(df[f"`{specs_col}`"], closed=True) if specs_col and specs_col in df.columns else F.create_map().cast("map<string,string>")
    tidy = F.transform(F.map_entries(own), lambda e: F.struct(strip(e["key"]).alias("key"), strip(F.coalesce(e["value"], F.lit(""))).alias("value")))
    cols = [c for c in df.columns if c.lower().startswith("spec_") and c not in CHANNEL_SKIPS]
    more = F.array(*[F.struct(F.lit(c).alias("key"), strip(F.coalesce(df[f"`{c}`"].cast("string"), F.lit(""))).alias("value")) for c in cols]) if cols else F.array().cast("array<struct<key:string,value:string>>")
    good = lambda e: (e["key"] != "") & (e["value"] != "") & ~e["key"].isin(*CHANNEL_SKIPS)
    # the last of equal keys stands
    last = lambda held: F.filter(held, lambda e, i: ~F.exists(F.slice(held, i + 2, F.size(held)), lambda x: x["key"] == e["key"]))
    new = lambda held: F.filter(F.filter(more, good), lambda e: ~F.exists(held, lambda x: x["key"] == e["key"]))
    return let(F.filter(tidy, good), lambda held: F.map_from_entries(F.concat(last(held), new(held))))


def specs_text(entries: Column) -> Column:
    """``Label: value`` lines by lower-cased key."""
    order = F.array_sort(F.transform(F.map_entries(entries), lambda e: F.struct(F.lower(e["key"]).alias("l"), e["key"].alias("k"), e["value"].alias("v"))))
    out = F.array_join(F.transform(order, lambda e: F.concat(human_label(e["k"]), F.lit(": "), e["v"])), "\n")
    return let(out, lambda o: F.when(o == "", "(no specs)").otherwise(o))


def build_channels(df: DataFrame, order: str = "row_id", specs_col: str | None = "specs", columns: dict[str, str] | None = None) -> DataFrame:
    """``(row_id, name, brand, sku, mpn, url, specs_col, description, title_text, desc_text, specs_text)``; ``columns`` names first choices."""
    pick = {k: first_of(df, *([columns[k]] if columns and k in columns else []), *chain) for k, chain in CHAINS.items()}
    picked = df.select(df[f"`{order}`"].alias("row_id"), *[c.alias(k) for k, c in pick.items()], F.lit(specs_col).alias("specs_col"), spec_entries(df, specs_col).alias("entries"))
    return picked.select(
        "row_id", "name", "brand", "sku", "mpn", "url", "specs_col", "description", title_text(F.col("name"), F.col("brand"), F.col("description")).alias("title_text"),
        F.when(F.col("description") == "", "(no description)").otherwise(F.col("description")).alias("desc_text"), specs_text(F.col("entries")).alias("specs_text"),
    )


def meta_rows(channels: DataFrame) -> DataFrame:
    """What results show, with cut texts."""
    return channels.select("row_id", "name", "brand", "sku", "mpn", "url", "specs_col", "description", F.substring("title_text", 1, 400).alias("raw_title"), F.substring("desc_text", 1, 400).alias("raw_desc"), F.substring("specs_text", 1, 800).alias("raw_specs"))
