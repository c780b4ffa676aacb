"""Line dedup: windows of three lines that occur anywhere before are removed, overlaps merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS


def _line_windows(text: Column, width: int) -> Column:
    """``array<struct<a, b, st, en>>``: two hashes of each run of ``width`` lines with words, and its first and last line."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.trim(x, F.lit(BLANKS)).alias("x"), i.alias("i")))
    held = F.transform(F.filter(lines, lambda s: s["x"] != ""), lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"), F.xxhash64(F.lit(7), s["x"]).alias("g")))

    def windows(a: Column) -> Column:
        at = lambda k, j: F.get(a, k + j)
        one = lambda k: F.struct(
            F.xxhash64(*[at(k, j)["h"] for j in range(width)]).alias("a"), F.xxhash64(F.lit(7), *[at(k, j)["g"] for j in range(width)]).alias("b"),
            at(k, 0)["i"].alias("st"), at(k, width - 1)["i"].alias("en"),
        )
        return F.when(F.size(a) >= width, F.transform(F.sequence(F.lit(0), F.size(a) - width), one))

    return F.get(F.transform(F.array(held), windows), F.lit(0))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, info_col: str = "lines") -> DataFrame:
    """``docs`` with later occurrences of repeated line windows cut from ``text_col``.

    All columns of ``docs`` are kept, whatever their names, and a struct of ``total`` and
    ``removed`` is added last, as ``info_col`` (with ``_`` at its end where a column is so named).  Lines end at ``\\n`` and are compared
    without blanks at their ends; lines without words are skipped when windows are formed and
    go with a window that spans them.  The first occurrence, by document id (null last), text
    hash and line, stays; every later window goes, and covered lines are merged.  Texts of
    fewer than ``width`` such lines and null texts stay as they are.  Rows of one id and text
    count as one occurrence and all stay, cut alike.

    A window is told by 128 bits of hash.  Counting combines before its shuffle; the join of
    windows with their first places is one that adaptive execution splits where a window is hot.
    Texts are shuffled once, by id, to meet their spans.
    """
    while info_col in docs.columns:
        info_col += "_"
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text, key = F.col("row")[text_col], F.col("row")[id_col]
    keyed = rows.select("row", key.alias("k"), F.xxhash64(text).alias("t"))
    wins = keyed.select("k", "t", F.explode(_line_windows(text, width)).alias("w"))
    wins = wins.select("w.a", "w.b", F.struct(F.col("k").isNull().alias("z"), F.col("k").alias("k"), F.col("t").alias("t"), F.col("w.st").alias("st"), F.col("w.en").alias("en")).alias("p"))
    first = wins.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("p").alias("first")).where("n > 1").select("a", "b", "first")
    later = wins.join(first, ["a", "b"]).where("p > first")
    spans = later.groupBy("p.k", "p.t").agg(F.sort_array(F.collect_set(F.struct("p.st", "p.en"))).alias("cut"))
    spans = spans.select(F.col("k").alias("k2"), F.col("t").alias("t2"), "cut")
    both = keyed.join(spans, F.col("k").eqNullSafe(F.col("k2")) & (F.col("t") == F.col("t2")), "left")
    lines = both.select("row", "cut", F.split(text, "\n", -1).alias("l"))

    def gap(x: Column, j: Column) -> Column:
        # ends grow with starts, so the last line covered so far is the span before's end
        start = F.coalesce(F.when(j > 0, F.get(F.col("cut"), j - 1)["en"] + 1), F.lit(0))
        return F.slice(F.col("l"), start + 1, F.greatest(x["st"] - start, F.lit(0)))

    last = F.get(F.col("cut"), F.size("cut") - 1)["en"] + 1
    kept = F.flatten(F.concat(F.transform("cut", gap), F.array(F.slice(F.col("l"), last + 1, F.greatest(F.size("l") - last, F.lit(0))))))
    done = lines.select("row", F.size("l").alias("total"), F.when(F.col("cut").isNotNull(), kept).alias("kept"))
    n = F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.col("total"))
    new = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row")[text_col])
    removed = F.coalesce(F.col("total") - F.size("kept"), F.lit(0))
    info = F.struct(n.cast("long").alias("total"), F.when(F.col("kept").isNull(), 0).otherwise(removed).cast("long").alias("removed"))
    return done.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns], info.alias(info_col))
