"""URL filters: longest-match host and path rules, spread over redirect and canonical-link aliases."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

#: (verdict, host/path) of the production query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"

BASE = r"(?is)<base\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null; ties go to allow.

    ``rules`` is a parameter held by the driver, a few thousand at most.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1]))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    split = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for v, r in ordered]
    table = F.array(*[F.struct(*(F.lit(x).alias(n) for n, x in zip(("host", "path", "rule", "verdict"), s))) for s in split])
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(F.transform(fits, lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))), F.lit(0))


def alias_key(url: Column) -> Column:
    """A fixed-width key of a URL without its scheme and fragment; null if it has no host."""
    key = F.concat_ws("\n", url_host(url), url_path(url), F.regexp_extract(url, PARTS, 3))
    return F.when(url_host(url) != "", F.md5(key))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments."""
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/", -1)
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def absolute(target: Column, base: Column) -> Column:
    """A link's target made absolute; null where it names no host (``mailto:``) or is empty."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.coalesce(F.nullif(url_path(base), F.lit("")), F.lit("/"))
    tail = F.regexp_extract(target, r"(?s)([?#].*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    return (
        F.when(F.rlike(target, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), F.when(F.contains(target, F.lit("://")), target))
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?):", 1), F.lit(":"), target))
        .when((target == "") | F.startswith(target, F.lit("#")), F.lit(None))
        .when(F.startswith(target, F.lit("?")), F.concat(root, path, target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, without_dots(own), tail))
        .otherwise(F.concat(root, without_dots(F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), own)), tail))
    )


def html_links(html: Column, url: Column) -> Column:
    """Targets of canonical links and of refresh redirects in a page, made absolute against its ``<base href>`` or its URL."""
    pick = lambda tag, pattern: F.regexp_extract(tag, pattern, 1)
    canonical = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda t: pick(t, HREF))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: pick(t, TARGET))
    told = pick(F.regexp_extract(html, BASE, 0), HREF)
    base = F.coalesce(absolute(told, url), url)
    return F.filter(_let(base, lambda b: F.transform(F.concat(canonical, refresh), lambda u: absolute(u, b))), lambda u: F.contains(u, F.lit("://")))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(from_url, to_url)``: one row a canonical link or refresh redirect found in a page."""
    src = pages.select(pages[url_col].alias("from_url"), pages[html_col].alias("h")).where("from_url is not null and h is not null")
    return src.select("from_url", F.explode(html_links(F.col("h"), F.col("from_url"))).alias("to_url"))


def judge_urls(pages: DataFrame, edges: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row a page.

    ``edges (from_url, to_url)`` are redirects and canonical links.  A page that a rule
    fits has that rule's verdict.  Any other page takes its alias component's: allow if a
    rule allows any URL of it, else block if a rule blocks one, else allow.  A null URL or
    one without ``://`` has empty host and path, fits no rule and has no alias: allow.
    Repeated pages and null ids give a row each; other columns are not read.
    """
    links = cut(edges.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")).select("a", "b", alias_key(F.col("a")).alias("u"), alias_key(F.col("b")).alias("v")).where("u != v"))
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("url"), F.col("u").alias("node")), F.struct(F.col("b").alias("url"), F.col("v").alias("node")))).alias("e")).select("e.*").distinct()
    ruled = ends.select("node", fitting_rule(url_host(F.col("url")), url_path(F.col("url")), rules)["verdict"].alias("verdict"))
    members = connected_components(links, "u", "v")
    decided = ruled.join(members, "node").groupBy("component").agg(F.when(F.bool_or(F.col("verdict") == "allow"), "allow").when(F.bool_or(F.col("verdict") == "block"), "block").otherwise("allow").alias("alias_verdict"))
    by_node = members.join(decided, "component").select("node", "alias_verdict")
    src = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    src = src.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), alias_key(F.col("url")).alias("node"))
    src = src.withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    # pages without a host have no alias; a key of their own keeps them apart
    src = src.withColumn("node", F.coalesce("node", F.concat(F.lit("-"), F.xxhash64("page_id", "host", "path").cast("string"))))
    out = src.join(by_node, "node", "left")
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("alias_verdict"), F.lit("allow")).alias("verdict"))
