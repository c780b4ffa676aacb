"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from functools import reduce
from math import floor, log
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Rows of a cell (one source, one size) that one task may rank.
RANKED = 10_000


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``place``, its rows' places from 0 in ``order``: sorted by range, with counts of the ranges added up."""
    held = cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    starts = held.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return held.join(starts, "part").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).drop("part", "start")


def source_targets(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(sk, source_size, docs, target)`` from ``(source, sk, size)`` rows.

    Sources in code-point order, null last, take ``weights`` in turn and split ``share`` of
    all sizes; what is above ``cap`` times a source's size is shared again by weight until
    none is above.  That is ``min(cap * size, level * weight)``; the level rises to its place
    in a few passes, each of which sends two sums to the driver.
    """
    per = sized.groupBy("source", "sk").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    ranked = numbered(per, F.col("source").isNull(), F.col("source"))
    table = cut(ranked.select("sk", "source_size", "docs", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)).cast("double").alias("weight")))
    total, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    want, level = share * (total or 0), 0.0
    new = want / weight if weight else 0.0
    while new > level:
        level = new
        full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        held, free = table.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (want - (held or 0.0)) / free if free else level
    return table.select("sk", "source_size", "docs", F.least(F.col("source_size") * cap, F.lit(level) * F.col("weight")).alias("target"))


def balance(cells: DataFrame, targets: DataFrame, cap: float = 2.0, rounds: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """``(sk, lam, full)``: the dual solution of each source.

    The rates nearest in entropy to "every document once", with ``sum(rate * size) = target``
    and no rate above ``cap``, are ``min(cap, exp(lam * size / mean size))``.  Each Newton
    iteration sums the dual's gradient and curvature over ``cells (sk, size, n)`` in one
    distributed aggregation for all sources; a step outside the bracket found so far is
    replaced by its middle.  A source whose target is ``cap`` times its size is full.
    """
    state = targets.where("target > 0").select(
        "sk", "target", (F.col("source_size") / F.col("docs")).alias("mean"), (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("error"),
    )
    state = cut(state)
    for _ in range(rounds):
        z = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * z, F.lit(log(cap))))
        own = F.col("n") * F.col("size")
        sums = cells.join(state, "sk").groupBy("sk").agg(F.sum(own * rate).alias("words"), F.sum(F.when(F.col("lam") * z < log(cap), own * z * rate).otherwise(0.0)).alias("slope"))
        new = state.join(sums, "sk").withColumn("gap", F.col("words") - F.col("target"))
        new = new.withColumns({"lo": F.when(F.col("gap") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("gap") >= 0, F.col("lam")).otherwise(F.col("hi")), "error": F.when(F.col("full"), 0.0).otherwise(F.abs("gap") / F.col("target"))})
        step = F.col("lam") - F.try_divide(F.col("gap"), F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        lam = F.when(F.col("error") <= tolerance, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(new.select("sk", "target", "mean", "full", lam.alias("lam"), "lo", "hi", "error"))
        if (state.agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"the dual is not settled to {tolerance} after {rounds} rounds")
    return state.select("sk", "mean", "lam", "full")


def round_cells(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of each size of one source, from the largest down; what rounding leaves passes to the smaller sizes.

    Of the two whole numbers beside what is due, the one is taken that leaves least beyond what
    smaller sizes can still give or take, then the nearer one.
    """
    cells = cells.sort_values("size", ascending=False)
    sizes, wants, mosts = (cells[c].tolist() for c in ("size", "want", "most"))
    less = sum(wants)  # what smaller sizes can give up, and take on
    more = sum(m * s for m, s in zip(mosts, sizes)) - less
    carry, copies = 0.0, []
    for size, want, most in zip(sizes, wants, mosts):
        less, more = less - want, more - (most * size - want)
        due = want + carry
        near = {min(most, max(0, floor(due / size) + up)) for up in (0, 1)}
        took = min(sorted(near), key=lambda c: (max(0.0, due - c * size - more, c * size - due - less), abs(due - c * size)))
        copies.append(took)
        carry = due - took * size
    return cells.assign(copies=copies)[["sk", "size", "n", "copies"]]


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, text_hash, source_key)``, one row a document.

    Words of a source's documents are counted by size, its rates solved in the dual, and
    rounded to copies size by size; which documents of one size get one more is told by a
    hash of their ids, so reruns agree.  Texts without words take nothing.  A null
    source is one source; repeated rows and null ids stay; other columns are not read.
    Rounding sees one row for each size of a source, of which there are at most as many as
    words in the longest text.  A size that many documents share is ranked in buckets.
    """
    sized = cut(docs.select(
        docs[id_col].alias("k"), docs[source_col].alias("source"), source_key(docs[source_col]).alias("sk"), n_words(docs[text_col]).alias("size"), F.xxhash64(docs[text_col]).alias("text_hash"),
    ))
    targets = cut(source_targets(sized, weights, share, cap))
    cells = cut(sized.where("size > 0").groupBy("sk", "size").agg(F.count("*").alias("n")))
    solved = balance(cells, targets, cap)
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(log(cap)))))
    wanted = cells.join(solved, "sk").select("sk", "size", "n", (F.col("n") * F.col("size") * rate).alias("want"), (F.col("n") * cap).alias("most"))
    copies = wanted.groupBy("sk").applyInPandas(round_cells, "sk string, size long, n long, copies long")
    copies = cut(copies.withColumn("buckets", F.ceil(F.col("n") / RANKED).cast("int")))
    mark = F.xxhash64(F.lit(9), "k")
    placed = sized.join(copies, ["sk", "size"], "left").withColumn("bucket", F.pmod(mark, F.coalesce("buckets", F.lit(1))).cast("int"))
    split = placed.where("buckets > 1").groupBy("sk", "size", "bucket").agg(F.count("*").alias("own"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    upto = F.sum("own").over(Window.partitionBy("sk", "size").orderBy("bucket"))  # over one row for RANKED rows
    due = lambda seen: F.floor((F.col("copies") % F.col("n")) * seen / F.col("n"))
    split = split.select("sk", "size", "bucket", upto.alias("upto"), "own", "n", "copies").select("sk", "size", "bucket", (due(F.col("upto")) - due(F.col("upto") - F.col("own"))).alias("some"))
    placed = placed.join(split, ["sk", "size", "bucket"], "left")
    extra = F.coalesce("some", F.col("copies") % F.col("n"))
    rank = F.row_number().over(Window.partitionBy("sk", "size", "bucket").orderBy(mark, "k"))
    # documents without words need no rank: a bucket by hash keeps them apart
    spread = placed.withColumn("bucket", F.when(F.col("n").isNull(), F.pmod(F.xxhash64("k", "text_hash"), F.lit(1 << 20)).cast("int")).otherwise(F.col("bucket")))
    ranked = spread.withColumn("copies", F.coalesce(F.floor(F.col("copies") / F.col("n")) + F.when(rank <= extra, 1).otherwise(0), F.lit(0)).cast("long"))
    out = ranked.join(targets.select("sk", "source_size", "target"), "sk")
    return out.select(F.col("k").alias(id_col), "size", F.col("source_size").cast("long"), F.col("target").cast("double"), (F.col("size") * F.col("copies")).alias("taken"), "copies", "text_hash", F.col("sk").alias("source_key"))


def mixed_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, each row as many times as ``mix_sources`` gave it copies.

    Rows of one id, text and source have the sum of their copies among them, in turn from the
    least hash of a row; which of several equal rows gives one more doesn't matter.
    """
    key = ["k", "t", "sk"]
    per = mixed.groupBy(F.col(id_col).alias("k"), F.col("text_hash").alias("t"), F.col("source_key").alias("sk")).agg(F.sum("copies").alias("total"), F.count("*").alias("m"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row")[id_col].alias("k"), F.xxhash64(F.col("row")[text_col]).alias("t"), source_key(F.col("row")[source_col]).alias("sk"), F.xxhash64("row").alias("h"))

    def same(a: DataFrame, b: DataFrame, names) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"{c}2") for c in names], *[c for c in b.columns if c not in names])
        on = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in names]
        return a.join(b, reduce(and_, on)).drop(*[f"{c}2" for c in names])

    kinds = same(rows.groupBy(*key, "h").agg(F.count("*").alias("c")), per, key)
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*key).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.least(F.greatest(F.expr("total % m") - before, F.lit(0)), F.col("c"))
    kinds = kinds.withColumn("more", more).select(*key, "h", (F.expr("total div m") + F.expr("more div c")).alias("each"), F.when(F.col("more") < F.col("c"), F.col("more")).otherwise(0).alias("some"))
    kinds = cut(kinds.where("each > 0 or some > 0"))
    out = same(rows, kinds.where("each > 0").drop("some"), [*key, "h"]).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each").cast("long")))).select("row")
    if not kinds.where("some > 0").isEmpty():
        # some of several equal rows: counted in parts of at most RANKED rows
        parts = rows.withColumn("part", F.floor(F.monotonically_increasing_id() / RANKED))
        held = cut(same(parts, kinds.where("some > 0").drop("each"), [*key, "h"]))
        own = held.groupBy(*key, "h", "part").agg(F.count("*").alias("own"))
        start = F.coalesce(F.sum("own").over(Window.partitionBy(*key, "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        own = own.select(*key, "h", "part", start.alias("start"))
        place = F.row_number().over(Window.partitionBy(*key, "h", "part").orderBy("h"))
        out = out.unionByName(same(held, own, [*key, "h", "part"]).withColumn("place", place).where("start + place <= some").select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
