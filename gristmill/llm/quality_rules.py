"""Quality rules with cutoffs that limit false rejection, certified by exact binomial bounds."""

from __future__ import annotations

from math import log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, cut

#: (rule, measure, whether high values are rejected, cutoffs from strict to mild).
RULES = (
    ("symbols", "symbols_per_word", True, (0.05, 0.1, 0.2, 0.3, 0.5, 1.0)),
    ("dup_lines", "dup_line_share", True, (0.05, 0.1, 0.2, 0.3, 0.5)),
    ("repeats", "repeat_share", True, (0.02, 0.05, 0.1, 0.2)),
    ("long_words", "chars_per_word", True, (7.0, 8.0, 10.0, 12.0, 15.0)),
    ("short_words", "chars_per_word", False, (4.0, 3.5, 3.0, 2.5, 2.0)),
)


def tightening(rules=RULES) -> list[dict[str, float]]:
    """The sequence of settings that are tested: all rules at their mildest cutoff, then one rule after the other a step stricter, in turn."""
    now = {r: len(cuts) - 1 for r, _, _, cuts in rules}
    path = [dict(now)]
    while any(now.values()):
        for r in now:
            if now[r]:
                now[r] -= 1
                path.append(dict(now))
    return [{r: cuts[at[r]] for r, _, _, cuts in rules} for at in path]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words under eight-word windows whose hash occurs again, from the array of window hashes, in n log n."""

    def twice(a: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(a, k)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(a, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def union(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(8), F.get(p, k + 1) - x), F.lit(8)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(let(tagged, twice), union))


def text_measures(text: Column) -> dict[str, Column]:
    """Measures that need no word list."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return {
        "word_chars": F.coalesce(F.length(F.translate(text, BLANKS, "")), F.lit(0)).cast("long"),
        "n_symbols": F.coalesce(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0)).cast("long"),
        "dup": let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))),
    }


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row a document: ``doc_id, stratum`` and the measures of its whole text.

    A null text has no words; a null stratum is the stratum "".  Repeated rows and null
    ids stay; other columns are not read.  Windows are compared by 64-bit hashes within
    one text.  Nothing is shuffled.
    """
    src = docs.select(docs[id_col].alias("k"), F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("stratum"), docs[text_col].alias("t"))
    hashed = F.transform(F.coalesce(F.regexp_extract_all(F.col("t"), F.lit(WORD), F.lit(0)), F.array().cast("array<string>")), lambda w: F.xxhash64(w))
    one = src.select("k", "stratum", *[c.alias(n) for n, c in text_measures(F.col("t")).items()], hashed.alias("w"))
    eight = F.when(F.size("w") >= 8, F.transform(F.sequence(F.lit(0), F.size("w") - 8), lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(8)]))).otherwise(F.array().cast("array<long>"))
    two = one.select("k", "stratum", "word_chars", "n_symbols", "dup", F.size("w").cast("long").alias("n_words"), eight.alias("win"))
    return two.select(
        F.col("k").alias("doc_id"), "stratum", "n_words", "word_chars", "n_symbols", F.coalesce(F.col("dup.n_dup_lines"), F.lit(0)).cast("long").alias("n_dup_lines"),
        _covered(F.col("win")).cast("long").alias("n_repeat_words"), F.greatest(F.coalesce(F.col("dup.n_lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
    )


def with_shares(m: DataFrame) -> DataFrame:
    """``m``, as ``measures`` gives it, with what the rules look at; measures are written to the shared folder first, as each is read many times."""
    m = cut(m)
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return m.select(
        "*", per("n_symbols", "n_words").alias("symbols_per_word"), per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_repeat_words", "n_words").alias("repeat_share"), per("word_chars", "n_words").alias("chars_per_word"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms; 1 where k is at least n * p, as no bound can hold there."""
    first = n * F.lit(log1p(-p))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + F.lit(log(p) - log1p(-p))
        top = F.greatest(s["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(s["total"] - top) + F.exp(term - top))).alias("total"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(terms, F.struct(first.alias("term"), first.alias("total")), step)["total"]
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(total))


def rejecting_step(rules=RULES) -> Column:
    """The first setting of ``tightening`` under which a row of ``with_shares`` is rejected; one beyond the last if none is."""
    path = tightening(rules)
    out = F.lit(len(path))
    for r, measure, high, cuts in rules:
        for c in cuts:
            start = next(i for i, at in enumerate(path) if at[r] == c)
            out = F.least(out, F.when(F.col(measure) > c if high else F.col(measure) < c, F.lit(start)).otherwise(F.lit(len(path))))
    return out


def certified_steps(shares: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, rules=RULES, label_id: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """``(stratum, n, step, cutoffs)``: the strictest setting that is certified in a stratum, strata with none left out.

    ``shares (doc_id, stratum, base_failed, step)``.  Settings are tested from mild to strict and
    the first that fails ends the sequence, so that none but the strata share ``delta``
    (fixed-sequence tests, Bonferroni over strata).  A setting passes if, over the stratum's
    labelled good documents that pass the base rules, the exact binomial test rejects "more than
    ``risk`` of them are rejected by some rule" at level delta / strata.  So with probability
    1 - delta every stratum loses at most ``risk`` of its good documents.  A document with
    several labels counts by its lowest.
    """
    path = tightening(rules)
    good = labels.select(labels[label_id].alias("doc_id"), labels[quality_col].alias("q")).where("doc_id is not null").groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").select("doc_id")
    held = shares.where("not base_failed").join(good, "doc_id", "left_semi")
    # a row for each stratum and step
    counts = cut(held.groupBy("stratum", "step").agg(F.count("*").alias("own")))
    strata = counts.select("stratum").distinct().count()
    steps = counts.groupBy("stratum").agg(F.sum("own").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "own"))).alias("own"))
    upto = lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("long"), lambda s, j: s + F.coalesce(F.try_element_at("own", j), F.lit(0)))
    tested = F.transform(F.sequence(F.lit(0), F.lit(len(path) - 1)), lambda i: binomial_tail(F.col("n"), upto(i), risk) <= delta / max(1, strata))
    fails = F.coalesce(F.nullif(F.array_position(tested, F.lit(False)), F.lit(0)), F.lit(len(path) + 1))
    settings = F.array(*[F.struct(*[F.lit(c).alias(r) for r, c in at.items()]) for at in path])
    return steps.select("stratum", "n", (fails - 2).cast("int").alias("step")).where("step >= 0").select("stratum", "n", "step", F.get(settings, F.col("step")).alias("cutoffs"))


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, rules=RULES, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and ``stratum``.

    Not kept: documents that fail the base rules, or a rule at the cutoffs certified for their
    stratum.  Repeated rows and null ids give a row each; a null id has no label.
    """
    shares = with_shares(measures(docs, id_col, text_col, stratum_col)).withColumn("step", rejecting_step(rules))
    certified = cut(certified_steps(shares, labels, risk, delta, rules)).select("stratum", F.col("step").alias("certified"))
    out = shares.join(certified, "stratum", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("step") > F.col("certified"), F.lit(True))
    return out.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum")
