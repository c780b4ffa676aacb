"""``python -m gristmill harvest | mine | index | search``: the catalog engine on files."""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import SparkSession

from .operators import embed, harvest
from .operators.search import SearchOptions
from .plans import catalog, files
from .sources.catalog import read_catalog
from .sources.sinks import write_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gristmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    each = {}
    for name, told in (("harvest", "count the keys of a catalog"), ("mine", "keys, fields, aliases and audits"), ("index", "vectors and numbers of a catalog"), ("search", "ask an index")):
        each[name] = sub.add_parser(name, help=told)
    for name in ("harvest", "mine", "index"):
        one = each[name]
        one.add_argument("--catalog", required=True, help="CSV with a header")
        one.add_argument("--out", required=True)
        one.add_argument("--specs-col", default="specs")
        one.add_argument("--max-rows", type=int, default=0)
    for name in ("mine", "index"):
        one = each[name]
        one.add_argument("--min-support", type=int, default=3)
        one.add_argument("--thread-share", type=float, default=1.0)
        one.add_argument("--keep-meta", action="store_true")
        one.add_argument("--max-aliases", type=int, default=5)
        one.add_argument("--only-ids", default="", help="ids with commas between")
        one.add_argument("--families", default="", help="hard families with commas between")
        one.add_argument("--block-bare", action="store_true", help="no bare OD and ID for scoped diameters")
    each["mine"].add_argument("--dry-run", action="store_true")
    each["index"].add_argument("--literal", action="store_true", help="leave classified numbers null, as the literal reading has it")
    for name in ("index", "search"):
        each[name].add_argument("--dims", type=int, default=64, help="dimensions of the hash embedder")
    one = each["search"]
    one.add_argument("--index", required=True)
    one.add_argument("--query", action="append", required=True)
    for f in fields(SearchOptions):
        one.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    return p


def mined(df, a, dry_run: bool = False) -> catalog.Mined:
    more = {"families": a.families.split(",")} if a.families else {}
    return catalog.mine(df, a.specs_col, min_support=a.min_support, thread_share=a.thread_share, drop_meta=not a.keep_meta, max_aliases=a.max_aliases, only_ids=tuple(filter(None, a.only_ids.split(","))), block_bare=a.block_bare, dry_run=dry_run, **more)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("gristmill").getOrCreate()
    if a.command == "search":
        options = replace(SearchOptions(), **{f.name: getattr(a, f.name) for f in fields(SearchOptions)})
        index = files.read_index(spark, a.index, embed.hash_embedder(a.dims))
        asked = spark.createDataFrame(list(enumerate(a.query)), "query_id long, text string")
        found = index.search(asked, options).orderBy("query_id", "rank")
        found.select("query_id", "rank", "kind", "score", "row_id", "raw_title", "brand", "sku", "url", "description").show(len(a.query) * (options.k + 1), truncate=False)
        return 0
    df = read_catalog(spark, a.catalog, a.specs_col, max_rows=a.max_rows)
    if a.command == "harvest":
        keys = files.key_order(harvest.harvest_keys(df, a.specs_col, "row_id"))
        keys.select("key", "count", "example").show(20, truncate=60)
        write_csv(keys.coalesce(1), f"{a.out}/raw_keys.csv", ["key", "count", "example"])
    elif a.command == "mine":
        m = mined(df, a, a.dry_run)
        files.key_order(m.raw_keys).select("key", "count", "example").show(20, truncate=60)
        files.write_mined(m, a.out, a.dry_run)
    else:
        files.write_index(catalog.build_index(df, mined(df, a), embed.hash_embedder(a.dims), a.specs_col, literal=a.literal), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
