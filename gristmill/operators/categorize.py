"""Raw keys folded into typed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import CATEGORIES, IDENTIFIERS, META
from ..functions.text import fold, snake_id, strip, title_label
from ..functions.values import classify, unit_family

KINDS = {"scalar_known": "kind = 'scalar' and unit != ''", "scalar_unitless": "kind = 'scalar' and unit = ''", "range": "kind = 'range'", "dual": "kind = 'dual'", "thread": "kind = 'thread'", "unknown": "kind = 'unknown'"}


def fold_keys(raw: DataFrame) -> DataFrame:
    """``raw (key, count, example[, ord])`` with ``signature`` and ``ord`` (the key itself unless given); keys that are blank once folded go."""
    ord_ = F.col("ord") if "ord" in raw.columns else F.col("key")
    return raw.select("key", F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("example", F.lit("")).alias("example"), ord_.alias("ord"), fold(F.col("key")).alias("signature")).where("signature != ''")


def key_groups(raw: DataFrame) -> DataFrame:
    """``(signature, total, canonical, example, members, first)``, a row for each folded key."""
    best = F.min_by(F.struct("key", "example"), F.struct(-F.col("count"), F.lower("key"), F.col("ord")))
    g = fold_keys(raw).groupBy("signature").agg(F.sum("count").alias("total"), best.alias("best"), F.array_sort(F.collect_list(F.struct("ord", "key", "count", "example"))).alias("members"), F.min("ord").alias("first"))
    return g.select("signature", "total", F.col("best.key").alias("canonical"), F.col("best.example").alias("example"), "members", "first")


def summarize(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Counts and texts of each kind, units and families seen, per group: a partial and a final aggregation."""
    c = samples.withColumn("c", classify(F.col(value)))
    flat = c.select(*by, F.col(value).alias("v"), "c.kind", "c.unit", "c.family")
    aggs = [F.count_if(F.expr(cond)).alias(f"n_{k}") for k, cond in KINDS.items()]
    aggs += [F.slice(F.sort_array(F.collect_list(F.when(F.expr(cond), F.col("v")))), 1, 5).alias(f"s_{k}") for k, cond in KINDS.items()]
    units = F.when(F.col("unit") != "", F.col("unit"))
    return flat.groupBy(*by).agg(F.count("*").alias("n_samples"), *aggs, F.array_sort(F.collect_set(units)).alias("units_seen"), F.array_sort(F.collect_set(F.when(units.isNotNull(), F.col("family")))).alias("families_seen"))


def one_family(units):
    """The family that all units share, or null; no unit: null."""
    families = F.array_distinct(F.transform(units, unit_family))
    return F.when((F.size(families) == 1) & F.forall(families, lambda f: f.isNotNull()), F.get(families, F.lit(0)))


def decide(s: DataFrame, min_support: int = 3, thread_share: float = 1.0) -> DataFrame:
    """Type, family and decision of each summarised field ``(id, ...)``."""
    pinned = F.col("id").isin(*IDENTIFIERS, *CATEGORIES)
    others = F.col("n_range") + F.col("n_dual") + F.col("n_unknown")
    scalar = (others + F.col("n_thread") == 0) & (F.col("n_samples") > 0)
    share = F.coalesce(F.try_divide("n_thread", "n_samples"), F.lit(0.0))
    thread = (F.col("n_thread") > 0) & (share >= thread_share) & (others == 0)
    family = one_family(F.col("units_seen"))
    return s.select(
        "*", F.when(~pinned & scalar, "numeric").otherwise("string").alias("type"), F.when(~pinned & scalar, family).when(~pinned & ~scalar & thread, "thread").alias("unit_family"),
        F.when(pinned, F.array(F.lit("name_pin"))).when(scalar, F.array(F.lit("numeric_all_scalar"), F.when(family.isNotNull(), "family_single").otherwise("family_null_or_unitless")))
        .when(thread, F.array(F.lit("thread_only"))).otherwise(F.array(F.lit("string_with_violations"))).alias("path"),
        (pinned & F.col("id").isin(*IDENTIFIERS)).alias("id_pin"), (pinned & F.col("id").isin(*CATEGORIES)).alias("cat_pin"), (~pinned & (F.col("n_samples") < min_support)).alias("low_support"), F.when(~pinned & ~scalar & thread, F.round(share, 3)).alias("p_thread"),
    )


def seed_aliases(keyed: DataFrame, by: str = "id") -> DataFrame:
    """``(id, aliases array<struct<text, count, confidence>>)`` from ``(id, key, count)``: surface keys by falling count."""
    per = keyed.groupBy(by, "key").agg(F.sum("count").alias("n"))
    top = F.max("n").over(Window.partitionBy(by))
    ranked = per.withColumn("confidence", F.round(F.coalesce(F.least(F.lit(1.0), F.try_divide("n", top)), F.lit(1.0)), 3))
    return ranked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.lower("key").alias("l"), F.col("key").alias("text"), F.col("n").alias("count"), "confidence"))).alias("a")).select(by, F.transform("a", lambda x: F.struct(x["text"].alias("text"), x["count"].alias("count"), x["confidence"].alias("confidence"))).alias("aliases"))


def build_fields(raw: DataFrame, min_support: int = 3, thread_share: float = 1.0, drop_meta: bool = True) -> DataFrame:
    """One row a field: ``id, label, type, unit_family, count, example, aliases`` and the summary it was decided from.

    Order for reports: ``count`` descending, ``first``.  Groups whose ids fall together stay apart by ``signature``.
    """
    groups = key_groups(raw).withColumn("id", snake_id(F.col("signature")))
    if drop_meta:
        groups = groups.where(~F.col("id").isin(*META))
    members = groups.select("signature", "id", F.explode("members").alias("m")).select("signature", "id", "m.key", "m.count", strip(F.col("m.example")).alias("value"))
    summary = summarize(members.where("value != ''"), ["signature"])
    aliases = seed_aliases(members, "signature")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ["n_samples", *[f"n_{k}" for k in KINDS]]]
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in [*[f"s_{k}" for k in KINDS], "units_seen", "families_seen"]]
    wide = groups.join(summary, "signature", "left").join(aliases, "signature").select("signature", "id", title_label(F.col("id")).alias("label"), F.col("total").alias("count"), "example", "aliases", "members", "first", *counts, *lists)
    return decide(wide, min_support, thread_share)


def report(fields: DataFrame) -> DataFrame:
    """The flat report row of each field."""
    join = lambda c: F.array_join(c, ";")
    return fields.select(
        "id", "label", "type", F.coalesce("unit_family", F.lit("")).alias("unit_family"), "count", "n_samples", F.col("n_scalar_known").alias("n_scalar_unit"), "n_scalar_unitless", "n_range", "n_dual", "n_thread", "n_unknown",
        join("units_seen").alias("units_seen"), join("families_seen").alias("families_seen"), "example", F.array_join("path", "/").alias("decision"),
    )


def audit(fields: DataFrame) -> DataFrame:
    """One row an original key, with up to five samples of each kind and the decision of its group."""
    decision = F.struct("path", "id_pin", "cat_pin", "low_support", "p_thread", F.struct("n_range", "n_dual", "n_thread", "n_unknown").alias("counts")).alias("decision_inherited")
    keys = fields.select("id", "label", decision, F.explode("members").alias("m"))
    own = keys.withColumn("value", strip(F.col("m.example"))).withColumn("c", classify(F.col("value")))
    kind = F.when(F.col("value") == "", None).when((F.col("c.kind") == "scalar") & (F.col("c.unit") != ""), "scalar_known").when(F.col("c.kind") == "scalar", "scalar_unitless").otherwise(F.col("c.kind"))
    some = lambda cond, v: F.when(cond, F.array(v)).otherwise(F.array().cast("array<string>"))
    samples = F.struct(*[some(kind == k, F.col("value")).alias(k) for k in KINDS]).alias("samples")
    return own.select(
        F.col("m.key").alias("key"), F.col("id").alias("group_id"), F.col("label").alias("group_label"), F.col("m.count").alias("count"), samples,
        some(kind == "scalar_known", F.col("c.unit")).alias("units_seen"), some(kind == "scalar_known", F.col("c.family")).alias("families_seen"), F.when(F.col("value") == "", 0).otherwise(1).alias("n_samples"), "decision_inherited",
    )


def warnings(fields: DataFrame) -> DataFrame:
    """``(id, line)``: low support, mixed families, violations."""
    low = F.when(F.col("low_support"), F.format_string("[low-support] id=%s n_samples=%d", "id", "n_samples"))
    mixed = F.when((F.col("type") == "numeric") & F.col("unit_family").isNull() & (F.size("units_seen") > 0), F.concat(F.lit("[mixed-family] id="), "id", F.lit(" units=['"), F.array_join("units_seen", "', '"), F.lit("']")))
    bad = F.when((F.get("path", F.lit(0)) == "string_with_violations") & (F.col("n_range") + F.col("n_dual") + F.col("n_thread") + F.col("n_unknown") > 0), F.format_string("[violations] id=%s range=%d dual=%d thread=%d unknown=%d", "id", "n_range", "n_dual", "n_thread", "n_unknown"))
    return fields.select("id", F.explode(F.array_compact(F.array(low, mixed, bad))).alias("line"))
