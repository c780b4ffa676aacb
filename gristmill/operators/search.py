"""Hybrid catalog search for batches of queries."""

from __future__ import annotations

import difflib
import re
from bisect import bisect
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, looks_like_sku, object_query, parse_number, sku_form, strip
from ..functions.values import proximity, to_canonical, tolerance
from ..sources.held import hold, small


@dataclass(frozen=True)
class SearchOptions:
    k: int = 5
    w_title: float = 0.35
    w_desc: float = 0.50
    w_specs: float = 0.15
    w_full: float = 0.95
    w_obj: float = 0.05
    w_num: float = 0.25
    pull: int = 100
    per_list: int = 200
    semantic_pool: int = 600
    sku_cutoff: float = 0.70
    window: int = 48


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """The vector over its norm, to which 1e-12 is added."""
    norm = F.sqrt(dot(v, v)) + F.lit(1e-12)
    return let(norm, lambda n: F.transform(v.cast("array<double>"), lambda x: x / n))


SKU_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


class SkuBlock:
    """Normal forms, of which a query gets those with the best matching-block ratio (``difflib``'s, which is no edit distance).

    Matching blocks are a common subsequence, and its characters are common as multisets.  So forms are looked at
    by what their multiset allows, a class of equal multisets at once, then by their longest common subsequence,
    and are scored only while they may still be among the best.
    """

    def __init__(self, norms: list[str], ids: list[int]):
        import numpy as np

        order = sorted(range(len(norms)), key=norms.__getitem__, reverse=True)
        self.norms, self.ids = [norms[i] for i in order], [ids[i] for i in order]
        self.sizes = np.array([len(x) for x in self.norms])
        place = np.full(256, len(SKU_SIGNS), np.uint8)
        place[list(SKU_SIGNS.encode())] = np.arange(len(SKU_SIGNS))
        self.codes = place[np.frombuffer(b"".join(x.encode().ljust(self.sizes.max()) for x in self.norms), np.uint8)].reshape(len(norms), -1)
        counts = np.stack([(self.codes == c).sum(1) for c in range(len(SKU_SIGNS))], 1).astype(np.uint8)
        self.classes, own = np.unique(counts, axis=0, return_inverse=True)
        self.members = np.argsort(own.ravel(), kind="stable")
        self.edges = np.searchsorted(own.ravel()[self.members], np.arange(len(self.classes) + 1))
        self.class_sizes = self.classes.sum(1, dtype=np.int64)

    def common(self, q: str, rows):
        """Lengths of longest common subsequences, a bit for each character of the query."""
        import numpy as np

        masks = np.zeros(len(SKU_SIGNS) + 1, np.uint64)
        for i, c in enumerate(q):
            masks[SKU_SIGNS.index(c)] |= np.uint64(1 << i)
        v = np.full(len(rows), (1 << len(q)) - 1, np.uint64)
        for column in masks[self.codes[rows].T]:
            u = v & column
            v = (v + u) | (v - u)
        return len(q) - np.bitwise_count(v & np.uint64((1 << len(q)) - 1)).astype(np.int64)

    def best(self, q: str, n: int, cutoff: float) -> list[tuple[float, str, int]]:
        """``(ratio, norm, row_id)``, the best ``n`` by ratio, then by norm, both falling."""
        import numpy as np

        of_q = np.array([q.count(c) for c in SKU_SIGNS], np.uint8)
        bound = 2.0 * np.minimum(self.classes, of_q).sum(1, dtype=np.int64) / (self.class_sizes + len(q))
        levels = np.unique(bound[bound >= cutoff])[::-1]
        got: list[tuple[float, str, int]] = []
        match = difflib.SequenceMatcher()
        match.set_seq2(q)
        rows, most = np.empty(0, np.int64), np.empty(0)
        for i, level in enumerate(levels):
            if len(got) == n and got[-1][0] > level:
                break
            new = np.concatenate([self.members[self.edges[c] : self.edges[c + 1]] for c in np.flatnonzero(bound == level)])
            rows, most = np.concatenate([rows, new]), np.concatenate([most, 2.0 * self.common(q, new) / (self.sizes[new] + len(q))])
            now = most >= max(cutoff, levels[i + 1] if i + 1 < len(levels) else cutoff)
            for at in np.flatnonzero(now)[np.lexsort((rows[now], -most[now]))]:
                row, norm = rows[at], self.norms[rows[at]]
                if len(got) == n and most[at] < got[-1][0]:
                    break
                if len(got) == n and most[at] == got[-1][0] and norm < got[-1][1]:
                    continue
                match.set_seq1(norm)
                ratio = match.ratio()
                if ratio >= cutoff:
                    got = sorted([*got, (ratio, norm, self.ids[row])], reverse=True)[:n]
            rows, most = rows[~now], most[~now]
        return got


def sku_matches(queries: DataFrame, meta: DataFrame, n: int = 1, cutoff: float = 0.70, decompose: bool = True, block_rows: int = 1 << 18) -> DataFrame:
    """``(query_id, rank, row_id, norm, ratio)``: up to ``n`` rows by SKU likeness for queries that look like one.

    Of rows with one normal form the first counts.  Forms are dealt to blocks and queries to slices; a task finds
    the best of one block for each query of one slice (see ``SkuBlock``), and these are ranked again.
    """
    longest = int(24 * (2 - cutoff) / cutoff + 1e-9)  # queries have 24 characters at most
    forms = hold(meta.select("row_id", sku_form(F.col("sku"), decompose).alias("norm")).where(F.length("norm").between(1, longest)).groupBy("norm").agg(F.min("row_id").cast("long").alias("row_id")))
    all_asked = hold(queries.where(looks_like_sku(F.col("text"), decompose)).select(F.col("query_id").cast("long").alias("query_id"), sku_form(F.col("text"), decompose).alias("q")))
    # the first query of a form is asked for all that have it
    asked = hold(all_asked.groupBy("q").agg(F.min("query_id").alias("query_id")).select("query_id", "q"))
    first = all_asked.select("query_id", F.min("query_id").over(Window.partitionBy("q")).alias("first"))
    to_all = lambda df: df.withColumnRenamed("query_id", "first").join(first, "first").select("query_id", "rank", "row_id", "norm", "ratio")
    exact = None
    if n == 1 and cutoff <= 1:
        # no other form has a ratio of 1, so who asks for a form that is there needs no other looked at
        exact = asked.join(forms, asked.q == forms.norm).select("query_id", F.lit(1).alias("rank"), "row_id", "norm", F.lit(1.0).alias("ratio"))
        asked = hold(asked.join(forms, asked.q == forms.norm, "left_anti"))
        if not asked.count():
            return to_all(exact)
    blocks = max(1, -(-forms.count() // block_rows))
    slices = max(1, min(-(-4 * queries.sparkSession.sparkContext.defaultParallelism // blocks), asked.count() // 64))
    dealt_to = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = (F.col("block") * slices + F.col("slice")).cast("int").alias("tile")
    f = forms.withColumn("block", dealt_to(blocks, "norm")).withColumn("slice", every(slices)).select(tile, F.lit(0).alias("kind"), F.col("row_id").alias("id"), F.col("norm").alias("text"))
    a = asked.withColumn("slice", dealt_to(slices, "query_id")).withColumn("block", every(blocks)).select(tile, F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("text"))

    def run(batches):
        import pyarrow as pa

        key, norms, ids, block = None, [], [], None
        for b in batches:
            out = []
            for t, kind, i, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if t != key:
                    key, norms, ids, block = t, [], [], None
                if kind == 0:
                    norms.append(text), ids.append(i)
                elif norms:
                    block = block or SkuBlock(norms, ids)
                    out += [(i, row, norm, ratio) for ratio, norm, row in block.best(text, n, cutoff)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["query_id", "row_id", "norm", "ratio"])

    near = f.unionByName(a).repartitionById(blocks * slices, F.col("tile")).sortWithinPartitions("tile", "kind").mapInArrow(run, "query_id long, row_id long, norm string, ratio double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ratio"), F.desc("norm")))
    found = near.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "row_id", "norm", "ratio")
    return to_all(found if exact is None else exact.unionByName(found))


#: Aliases of which every executor may hold a table.
MOST_ALIASES = 100_000
_WORDS = r"[\p{L}\p{N}]+"


def alias_pattern(alias: str) -> re.Pattern:
    """An alias without case, any white space between its words, and not inside a word."""
    body = r"\s+".join(map(re.escape, alias.split()))
    return re.compile((r"\b" if re.match(r"\w", alias) else r"(?<!\w)") + body + (r"\b" if re.search(r"\w$", alias) else r"(?!\w)"), re.I)


def chosen_hits(text: str, aliases: Iterable[tuple[str, str]], patterns: dict[str, re.Pattern]) -> list[dict]:
    """Occurrences of ``(alias, field_id)`` by falling length, start and field, without those that overlap one chosen before."""
    found = set()
    for alias, field in aliases:
        if alias not in patterns:
            patterns[alias] = alias_pattern(alias)
        found.update((m.start() - m.end(), m.start(), m.end(), field) for m in patterns[alias].finditer(text))
    starts, chosen = [], []
    for _, st, en, field in sorted(found):
        at = bisect(starts, st)
        if (at == 0 or chosen[at - 1]["en"] <= st) and (at == len(starts) or chosen[at]["st"] >= en):
            starts.insert(at, st)
            chosen.insert(at, {"st": st, "en": en, "field_id": field})
    return chosen


_HITS = "array<struct<st:int,en:int,field_id:string>>"


def alias_hits(queries: DataFrame, aliases: DataFrame, most: int = MOST_ALIASES) -> DataFrame:
    """``(query_id, text, st, en, field_id)``: longest non-overlapping alias occurrences, greedy, then earliest.

    A text is held only against aliases whose first word it has.  Up to ``most`` aliases are sent to
    every executor by first word, and texts aren't shuffled at all; beyond that the words of texts
    are joined with the aliases', and the texts join what they met.  ``query_id`` tells texts apart.
    """
    spark = queries.sparkSession
    a = aliases.select(F.lower(strip(F.col("text"))).alias("alias"), "field_id").where("alias != ''").distinct()
    a = a.withColumn("w", F.regexp_extract("alias", _WORDS, 0))
    words = F.array_distinct(F.concat(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0)), F.array(F.lit(""))))
    few = a.limit(most + 1).collect()
    if len(few) <= most:
        table: dict[str, list] = {}
        for r in few:
            table.setdefault(r.w, []).append((r.alias, r.field_id))
        shipped = spark.sparkContext.broadcast(table)

        @F.pandas_udf(_HITS)
        def hits(text: pd.Series, words: pd.Series) -> pd.Series:
            held, patterns = shipped.value, {}
            return pd.Series([chosen_hits(t, [x for w in ws if w in held for x in held[w]], patterns) for t, ws in zip(text, words)], dtype="object")

        found = queries.where("text is not null").select("query_id", "text", F.explode(hits("text", words)).alias("c"))
    else:
        said = queries.select("query_id", F.explode(words).alias("w"))
        met = said.hint("merge").join(a, "w").groupBy("query_id").agg(F.collect_list(F.struct("alias", "field_id")).alias("met"))

        @F.pandas_udf(_HITS)
        def hits_of(text: pd.Series, met: pd.Series) -> pd.Series:
            patterns: dict[str, re.Pattern] = {}
            return pd.Series([chosen_hits(t, [(x["alias"], x["field_id"]) for x in m], patterns) for t, m in zip(text, met)], dtype="object")

        found = queries.select("query_id", "text").join(met, "query_id").select("query_id", "text", F.explode(hits_of("text", "met")).alias("c"))
    return found.select("query_id", "text", "c.st", "c.en", "c.field_id")


_N = r"(\d+\s*[- ]\s*\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)"
_U = r"(inch(?:es)?|in|mm|millimeters?|ft|foot|feet|[\"'])?"


def near_scalar(text: Column, st: Column, en: Column, window: int = 48) -> Column:
    """``struct<value, unit>`` of the number right of a hit, else of the one that ends left of it; or null."""
    right, left = F.substring(text, en + 1, F.lit(window)), F.substring(text, F.greatest(st - window, F.lit(0)) + 1, F.least(st, F.lit(window)))
    read = lambda s, p: F.struct(parse_number(F.regexp_extract(s, p, 1)).alias("value"), F.nullif(F.lower(F.regexp_extract(s, p, 2)), F.lit("")).alias("unit"))
    r = read(right, rf"(?i)^\s*[=:]?\s*{_N}\s*{_U}(?![\p{{L}}\p{{N}}])")
    le = read(left, rf"(?i)(?<![\d./]){_N}\s*{_U}\s*$")
    return F.when(r["value"].isNotNull(), r).when(le["value"].isNotNull(), le)


def constraints(hits: DataFrame, schema: DataFrame, window: int = 48) -> DataFrame:
    """``(query_id, st, field_id, family, value, tau, tau_boost, known)`` of the hits that a number stands beside."""
    near = hits.join(schema.select("field_id", "family", F.lit(True).alias("known")), "field_id", "left")
    # generators, as filters on plain columns would copy these expressions below the join
    near = near.withColumn("n", F.explode_outer(F.array(near_scalar(F.col("text"), F.col("st"), F.col("en"), window)))).where("n is not null")
    c = near.select("query_id", "st", "field_id", "family", F.coalesce("known", F.lit(False)).alias("known"), F.explode_outer(F.array(to_canonical(F.col("family"), F.col("n.value"), F.col("n.unit")))).alias("value")).where("value is not null")
    return c.select("*", tolerance(F.col("field_id"), F.col("family"), F.col("value")).alias("tau"), tolerance(F.col("field_id"), F.col("family"), F.col("value"), 0.0).alias("tau_boost"))


#: Parts that the rows of one bin are dealt to, so that no task has all pairs of a common value.
PARTS = 8


def _level(value: Column, tau: Column) -> Column:
    """The power of two that is as wide as the band, or wider where a double is coarser; 2000, one bin for all, without bound."""
    width = F.greatest(2 * tau, F.abs(value) * F.lit(2.0**-40), F.lit(2.0**-60))
    return F.when(width < F.lit(2.0**900), F.ceil(F.log2(width)).cast("int")).otherwise(2000)


def _bin(x: Column, level: Column) -> Column:
    return F.when(level == 2000, F.lit(0.0)).otherwise(F.floor(x / F.pow(F.lit(2.0), level)).cast("double"))


def near_rows(cons: DataFrame, numbers: DataFrame, boost_by: DataFrame | None = None) -> DataFrame:
    """``(query_id, row_id)`` of rows within tolerance on every constraint over a known field; with ``boost_by`` the least proximity to its constraints as well.

    Each row takes all its numbers along and each query all its constraints.  They meet in the bins that one
    constraint's band touches, the one whose bins hold fewest rows, and the others are tested there; so pairs
    are never shuffled, and a query without rows for a constraint meets none.
    """
    listed = lambda df, name: df.where("known").groupBy("query_id").agg(F.collect_list(F.struct("field_id", "value", "tau", "tau_boost")).alias(name))
    asked = listed(cons, "asked")
    asked = hold(asked.join(listed(boost_by, "told"), "query_id") if boost_by is not None else asked)
    rows = hold(numbers.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("field_id", F.col("value").cast("double").alias("x")))).alias("held")))
    each = asked.select("*", F.posexplode("asked").alias("pos", "c")).withColumn("level", _level(F.col("c.value"), F.col("c.tau")))
    pad = F.col("c.tau") + F.lit(1e-12) * (F.abs(F.col("c.value")) + F.col("c.tau"))
    low, high = (_bin(F.col("c.value") + sign * pad, F.col("level")) for sign in (-1, 1))
    # a band has its own width or less of bins, two or three
    bands = each.withColumn("bin", F.explode(F.transform(F.sequence(F.lit(0), F.least(high - low, F.lit(8.0)).cast("int")), lambda i: low + i))).withColumn("field_id", F.col("c.field_id"))
    levels = F.broadcast(each.select(F.col("c.field_id").alias("field_id"), "level").distinct())
    key = ["field_id", "level", "bin"]
    placed = rows.select("row_id", "held", F.explode("held").alias("field_id", "x")).join(levels, "field_id").withColumn("bin", _bin(F.col("x"), F.col("level")))
    counts = placed.groupBy(*key).agg(F.count("*").alias("n"))
    met = bands.select("query_id", "pos", *key).join(counts, key, "left").groupBy("query_id", "pos").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    # the whole constraint stands only where all have rows
    rarest = met.groupBy("query_id").agg(F.min_by("pos", F.struct("n", "pos")).alias("pos"), F.min("n").alias("n")).where("n > 0").select("query_id", "pos")
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    driven = bands.join(rarest, ["query_id", "pos"]).select(*asked.columns, "c", *key, parts)
    dealt = placed.select("row_id", "held", "x", *key, F.pmod(F.xxhash64("row_id"), F.lit(PARTS)).cast("int").alias("part"))
    of = lambda c: F.try_element_at(F.col("held"), c["field_id"])
    fits = F.forall("asked", lambda c: F.abs(of(c) - c["value"]) <= c["tau"])
    pairs = driven.hint("merge").join(dealt, [*key, "part"]).where(F.abs(F.col("x") - F.col("c.value")) <= F.col("c.tau")).where((F.size("asked") == 1) | fits)
    if boost_by is None:
        return pairs.select("query_id", "row_id")
    least = F.aggregate("told", F.lit(None).cast("double"), lambda s, c: F.least(s, proximity(of(c), c["value"], c["tau_boost"])))
    # a generator, as the expression would be copied into the filter
    return pairs.select("query_id", "row_id", F.explode(F.array(least)).alias("boost")).where("boost is not null")


def shortlist(cons: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(query_id, row_id)`` of rows within tolerance on every constraint over a known field."""
    return near_rows(cons, numbers)


def boosts(cons: DataFrame, numbers: DataFrame, rows: DataFrame) -> DataFrame:
    """``(query_id, row_id, boost)``: the least proximity over the constraints that a row has a value for."""
    held = rows.join(cons.where("known"), "query_id").join(numbers.select("row_id", "field_id", F.col("value").cast("double").alias("x")), ["row_id", "field_id"])
    return held.groupBy("query_id", "row_id").agg(F.min(proximity(F.col("x"), F.col("value"), F.col("tau_boost"))).alias("boost"))


CHANNELS = ("title", "desc", "specs")


def rank_lists(queries: DataFrame, vectors: DataFrame, channels=CHANNELS, block_rows: int = 1 << 16, unit: bool = False, components: int = 6_400_000) -> DataFrame:
    """``(query_id, variant, channel, rank, row_id, sim)``: exact top ``pull`` by inner product of unit vectors, to 12 decimals; ties to smaller ids.

    ``queries (query_id, variant, vec, pull)``, ``vectors (row_id, channel, vec)``; ``unit``: vectors are of length 1
    already, as an index holds them.
    """
    rank = F.row_number().over(Window.partitionBy("query_id", "variant", "channel").orderBy(F.desc("sim"), "row_id"))
    return block_lists(queries, vectors, channels, block_rows, unit, components).withColumn("rank", rank).where("rank <= pull").select("query_id", "variant", "channel", "rank", "row_id", "sim")


def block_lists(queries: DataFrame, vectors: DataFrame, channels=CHANNELS, block_rows: int = 1 << 16, unit: bool = False, components: int = 6_400_000) -> DataFrame:
    """``(query_id, variant, channel, pull, row_id, sim)``: of each block of rows the best ``pull`` of each list.

    Where ``vectors`` has ``n``, a row stands for so many, and a block's are those from its greatest similarity down to
    the one at which they stand for ``pull`` rows, with all that tie there.  A channel's rows are dealt to blocks of about ``block_rows``, fewer where
    vectors are long, so that a block has ``components`` numbers at most; its queries to as many slices as give
    every core work.  A task scores one slice against one block and sends on each list's ``pull`` best of the
    block; so a shuffle moves rows once a slice, queries and winners once a block, never a score for each pair.
    """
    import numpy as np
    import pyarrow as pa

    sizes = vectors.groupBy("channel").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).collect()
    most, dims = max((r.n for r in sizes), default=0), max((r.dims for r in sizes), default=1)
    blocks = max(1, -(-most // max(256, min(block_rows, components // max(dims, 1)))))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    slices = max(1, min(-(-2 * cores // (blocks * len(channels))), queries.count() // 64))
    dealt_to = lambda seed, n, *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(n)).cast("int")
    place = F.lit(0)
    for i, c in enumerate(channels):
        place = F.when(F.col("channel") == c, F.lit(i)).otherwise(place)
    tile = ((place * blocks + F.col("block")) * slices + F.col("slice")).cast("int").alias("tile")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.where(F.col("channel").isin(*channels)).withColumn("block", dealt_to(1, blocks, "row_id", "channel")).withColumn("slice", every(slices))
    weighted = "n" in vectors.columns
    v = v.select(tile, "channel", F.lit(0).alias("kind"), F.lit("").alias("variant"), (F.col("n").cast("int") if weighted else F.lit(0)).alias("pull"), F.col("row_id").cast("long").alias("id"), "vec")
    q = queries.withColumn("channel", F.explode(F.array(*map(F.lit, channels)))).withColumn("slice", dealt_to(2, slices, "query_id", "variant")).withColumn("block", every(blocks))
    q = q.select(tile, "channel", F.lit(1).alias("kind"), "variant", F.col("pull").cast("int").alias("pull"), F.col("query_id").cast("long").alias("id"), "vec")
    names = ["query_id", "variant", "channel", "pull", "row_id", "sim"]

    def matrix(batch, unit):
        out = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
        return out if unit else out / (np.sqrt(np.einsum("ij,ij->i", out, out)) + 1e-12)[:, None]

    def best_of(rows, ids, weights, batch, channel):
        took, places, sims = [], [], []
        for q, pull, score in zip(range(batch.num_rows), batch.column(4).to_pylist(), matrix(batch, False) @ rows.T):
            # rounded values keep the order, so none that could enter is below this
            some = np.flatnonzero(score >= np.partition(score, len(score) - pull)[len(score) - pull] - 2e-12) if pull < len(score) else np.arange(len(score))
            score = np.round(score[some], 12)  # equal vectors tie
            best = np.lexsort((ids[some], -score))
            if weighted:
                full = np.searchsorted(np.cumsum(weights[some[best]], dtype=np.int64), pull)
                best = best if full >= len(best) else best[: np.searchsorted(-score[best], -score[best[full]], "right")]
            else:
                best = best[:pull]
            took.append(np.full(len(best), q)), places.append(ids[some[best]]), sims.append(score[best])
        took = pa.array(np.concatenate(took))
        column = lambda i: batch.column(i).take(took)
        return pa.RecordBatch.from_arrays([column(5), column(3), pa.array([channel] * len(took)), column(4), pa.array(np.concatenate(places)), pa.array(np.concatenate(sims))], names)

    def run(batches):
        key, ids, weights, held, rows = None, [], [], [], None
        for b in batches:
            runs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            edges = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
            for lo, hi in zip(edges, edges[1:]):
                at_tile, channel, kind = runs[lo]
                if at_tile != key:
                    key, ids, weights, held, rows = at_tile, [], [], [], None
                some = b.slice(lo, hi - lo)
                if kind == 0:
                    ids.append(some.column(5).to_numpy())
                    weights.append(some.column(4).to_numpy())
                    held.append(matrix(some, unit))
                elif ids:
                    if rows is None:
                        rows, ids, weights, held = np.concatenate(held), [np.concatenate(ids)], [np.concatenate(weights)], []
                    step = max(1, 2_000_000 // len(rows))
                    for at in range(0, hi - lo, step):
                        yield best_of(rows, ids[0], weights[0], some.slice(at, step), channel)

    dealt = v.unionByName(q).repartitionById(len(channels) * blocks * slices, F.col("tile")).sortWithinPartitions("tile", "kind")
    return dealt.mapInArrow(run, "query_id long, variant string, channel string, pull int, row_id long, sim double")


def _mark(vec: Column) -> Column:
    """128 bits of a vector."""
    return F.concat_ws(":", F.xxhash64(F.lit(1), vec), F.xxhash64(F.lit(2), vec))


#: Row ids of one bin, within which places are counted row by row.
ID_BITS = 13


def list_ends(queries: DataFrame, vectors: DataFrame, channels=CHANNELS, unit: bool = False) -> DataFrame:
    """``(query_id, variant, channel, least, last)``: where each of ``rank_lists``' lists ends, without the lists.

    A row is on the list if its similarity is above ``least``, or equal and its id at most ``last``; both null: every row is.
    Equal vectors of rows count as one with their number, equal vectors of queries with the same ``pull`` are asked once,
    and of the rows that tie where a list ends the place is found by counts of bins of ids.
    """
    kinds = hold(vectors.where(F.col("channel").isin(*channels)).groupBy("channel", _mark(F.col("vec")).alias("mark")).agg(F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("kind", F.monotonically_increasing_id()))
    asked = hold(queries.select("query_id", "variant", "vec", "pull", _mark(F.col("vec")).alias("mark")))
    lists = hold(asked.groupBy("mark", "pull").agg(F.first("vec").alias("vec")).withColumn("list_id", F.monotonically_increasing_id()))
    met = block_lists(lists.select(F.col("list_id").alias("query_id"), F.lit("").alias("variant"), "vec", "pull"), kinds.select(F.col("kind").alias("row_id"), "channel", "vec", "n"), channels, unit=unit)
    met = met.select(F.col("query_id").alias("list_id"), "channel", "pull", F.col("row_id").alias("kind"), "sim").join(kinds.select("kind", "n"), "kind")
    level = met.groupBy("list_id", "channel", "pull", "sim").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("kind")).alias("kinds"))
    level = level.withColumn("upto", F.sum("n").over(Window.partitionBy("list_id", "channel").orderBy(F.desc("sim")).rowsBetween(Window.unboundedPreceding, 0)))
    place = (F.col("pull") - F.col("upto") + F.col("n")).alias("place")
    level = hold(level.where("upto >= pull and upto - n < pull").select("list_id", "channel", "sim", "n", place, "kinds", F.md5(F.concat_ws(",", "kinds")).alias("set_id")))
    ends = hold(level.where("place < n").select("set_id", "place").distinct())
    sets = level.where("place < n").groupBy("set_id").agg(F.first("kinds").alias("kinds")).select("set_id", F.explode("kinds").alias("kind")).join(kinds.select("kind", "channel", "mark"), "kind").select("set_id", "channel", "mark")
    rows = vectors.select("row_id", "channel", _mark(F.col("vec")).alias("mark"))
    tied = hold(rows.join(small(hold(sets)), ["channel", "mark"]).select("set_id", F.col("row_id").cast("long").alias("row_id"), F.shiftright(F.col("row_id").cast("long"), ID_BITS).alias("bin")))
    bins = tied.groupBy("set_id", "bin").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("set_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    here = hold(bins.join(ends, "set_id").where("upto >= place and upto - n < place").select("set_id", "bin", "place", (F.col("place") - F.col("upto") + F.col("n")).alias("nth")))
    nth = F.row_number().over(Window.partitionBy("set_id", "bin").orderBy("row_id")).alias("nth")
    last = tied.join(small(here.select("set_id", "bin").distinct()), ["set_id", "bin"]).select("set_id", "bin", "row_id", nth).join(here, ["set_id", "bin", "nth"]).select("set_id", "place", F.col("row_id").alias("last"))
    found = level.join(last, ["set_id", "place"], "left").select("list_id", "channel", F.col("sim").alias("least"), F.coalesce("last", F.lit((1 << 63) - 1)).alias("last"))
    each = asked.select("query_id", "variant", "mark", "pull").join(lists.select("mark", "pull", "list_id"), ["mark", "pull"]).withColumn("channel", F.explode(F.array(*map(F.lit, channels))))
    return each.join(found, ["list_id", "channel"], "left").select("query_id", "variant", "channel", "least", "last")


def shortlist_best(asked: DataFrame, short: DataFrame, query_vectors: DataFrame, vectors: DataFrame, ends: DataFrame, o: SearchOptions, unit: bool = False, block_rows: int = 1 << 15, block_queries: int = 512) -> DataFrame:
    """``(query_id, row_id, score)``: at least the ``most`` best rows of a shortlist for each query that has it.

    ``asked (query_id, group_id, most)``, ``short (group_id, row_id, boost)``; ``ends`` tells which rows are on a query's lists.
    Rows on none take part only where none of the shortlist is.  A task scores some queries of a group against some of
    its rows and sends on the best, so neither lists nor pairs of a query and a row are ever shuffled.
    """
    import numpy as np
    import pyarrow as pa

    weights = {"full": o.w_full, "obj": o.w_obj}, {"title": o.w_title, "desc": o.w_desc, "specs": o.w_specs}
    dealt_to = lambda n, c: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    up = lambda n, of: F.ceil(F.col(n) / of).cast("int")
    sizes = hold(short.groupBy("group_id").agg(F.count("*").alias("n")).join(asked.groupBy("group_id").agg(F.count("*").alias("q")), "group_id").select("group_id", up("n", block_rows).alias("blocks"), up("q", block_queries).alias("slices")))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    head = [F.col("group_id"), F.col("block"), F.col("slice")]
    r = short.join(sizes, "group_id").withColumn("block", dealt_to("blocks", "row_id")).join(vectors, "row_id").withColumn("slice", every("slices"))
    r = r.select(*head, F.lit(0).alias("kind"), F.col("row_id").cast("long").alias("id"), F.col("channel").alias("name"), F.col("vec").cast("array<double>").alias("vec"), "boost", none("array<double>", "least"), none("array<long>", "last"), F.lit(0).alias("most"))
    of = lambda c, n: F.max(F.when(F.col("channel") == c, F.col(n)))
    end = ends.groupBy("query_id", "variant").agg(*[F.array(*[F.coalesce(of(c, n), F.lit(no)) for c in CHANNELS]).alias(n) for n, no in (("least", -9.0), ("last", 0))])
    a = asked.join(sizes, "group_id").join(query_vectors.select("query_id", "variant", "vec").join(end, ["query_id", "variant"]), "query_id").withColumn("slice", dealt_to("slices", "query_id")).withColumn("block", every("blocks"))
    a = a.select(*head, F.lit(1).alias("kind"), F.col("query_id").cast("long").alias("id"), F.col("variant").alias("name"), F.col("vec").cast("array<double>").alias("vec"), none("double", "boost"), "least", "last", F.col("most").cast("int").alias("most"))

    def matrix(column, unit):
        out = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return out if unit else out / (np.sqrt(np.einsum("ij,ij->i", out, out)) + 1e-12)[:, None]

    def best(rows, queries):
        rows, queries = (pa.Table.from_batches(x).combine_chunks().to_batches()[0] for x in (rows, queries))
        row_id, name, boost = (rows.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 7))
        ids, first = np.unique(row_id, return_index=True)
        boost = o.w_num * np.nan_to_num(boost[first].astype(np.float64), nan=0.0)
        by_channel = {}
        for c in CHANNELS:
            at = np.flatnonzero(name == c)
            if len(at):
                by_channel[c] = np.searchsorted(ids, row_id[at]), matrix(rows.take(pa.array(at)).column(6), unit)
        asked_id, variant = (queries.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
        vec, least, last = matrix(queries.column(6), False), queries.column(8).flatten().to_numpy().reshape(-1, len(CHANNELS)), queries.column(9).flatten().to_numpy().reshape(-1, len(CHANNELS))
        every_id, first = np.unique(asked_id, return_index=True)
        most = queries.column(10).to_numpy()[first]
        step = max(1, 1_000_000 // len(ids))
        for lo in range(0, len(every_id), step):
            some = every_id[lo : lo + step]
            sem, met = np.zeros((len(some), len(ids))), np.zeros((len(some), len(ids)), bool)
            for v, w_v in weights[0].items():
                at = np.flatnonzero((variant == v) & (asked_id >= some[0]) & (asked_id <= some[-1]))
                own = np.searchsorted(some, asked_id[at])
                for i, c in enumerate(CHANNELS):
                    if c in by_channel and len(at):
                        place, held = by_channel[c]
                        sim = np.round(vec[at] @ held.T, 12)
                        on = (sim > least[at, i, None]) | ((sim == least[at, i, None]) & (ids[place] <= last[at, i, None]))
                        sem[np.ix_(own, place)] += np.where(on, w_v * weights[1][c] * sim, 0.0)
                        met[np.ix_(own, place)] |= on
            for q, n, s, m in zip(some.tolist(), most[lo : lo + step].tolist(), sem, met):
                hit = bool(m.any())
                at = np.flatnonzero(m) if hit else np.arange(len(ids))
                score = s[at] + boost[at]
                key = np.round(score, 9)
                if n < len(at):
                    few = np.flatnonzero(key >= np.partition(key, len(key) - n)[len(key) - n])
                    at, score, key = at[few], score[few], key[few]
                order = np.lexsort((ids[at], -key))[:n]
                yield [q] * len(order), ids[at[order]].tolist(), score[order].tolist(), [hit] * len(order)

    def run(batches):
        def out():
            found = list(best(rows, queries)) if rows and queries else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f[i]]) for i in range(4)], ["query_id", "row_id", "score", "hit"])

        key, rows, queries = None, [], []
        for b in batches:
            tiles = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            edges = [0, *(i for i in range(1, len(tiles)) if tiles[i] != tiles[i - 1]), len(tiles)]
            for lo, hi in zip(edges, edges[1:]):
                if tiles[lo][:3] != key:
                    yield from out()
                    key, rows, queries = tiles[lo][:3], [], []
                (queries if tiles[lo][3] else rows).append(b.slice(lo, hi - lo))
        yield from out()

    tile = ("group_id", "block", "slice")
    got = r.unionByName(a).repartition(*tile).sortWithinPartitions(*tile, "kind").mapInArrow(run, "query_id long, row_id long, score double, hit boolean")
    any_hit = F.max("hit").over(Window.partitionBy("query_id"))
    return got.withColumn("any_hit", any_hit).where("hit = any_hit").select("query_id", "row_id", "score")


def candidates(lists: DataFrame, short: DataFrame, constrained: DataFrame, o: SearchOptions, both: DataFrame | None = None) -> DataFrame:
    """``(query_id, row_id)`` to be scored.

    Without constraints: the lists' heads, at most ``semantic_pool`` by best similarity.  With
    them: what the lists share with the shortlist, else the shortlist.  Else the head of the
    title list of the full query.  ``both``: the rows that lists and shortlist share, where a caller can
    tell them without the shortlist, which has rows for each pair of a query and a row that fits it.
    """
    free = lists.join(constrained, "query_id", "left_anti").where(F.col("rank") <= max(o.per_list, 50 * o.k))
    pool = free.groupBy("query_id", "row_id").agg(F.max("sim").alias("best"))
    if o.semantic_pool > 0:
        pool = pool.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "row_id"))).where(F.col("place") <= o.semantic_pool)
    both = hold(lists.select("query_id", "row_id").distinct().join(short, ["query_id", "row_id"], "left_semi") if both is None else both)
    met = both.select("query_id").distinct()
    alone = short.join(met, "query_id", "left_anti")
    got = pool.select("query_id", "row_id").unionByName(both).unionByName(alone.select("query_id", "row_id"))
    # queries without constraints have a pool, those with a shortlist have rows of it
    head = lists.where((F.col("variant") == "full") & (F.col("channel") == "title") & (F.col("rank") <= max(10 * o.k, 100))).select("query_id", "row_id")
    rest = head.join(constrained.select("query_id").distinct(), "query_id", "left_semi").join(met, "query_id", "left_anti").join(short.select("query_id").distinct(), "query_id", "left_anti")
    return got.unionByName(rest)


def semantic_scores(cand: DataFrame | None, lists: DataFrame, o: SearchOptions) -> DataFrame:
    """``(query_id, row_id, sem)``: similarities weighted by variant and channel; a row absent from a list has 0 there.  No ``cand``: every row of the lists."""
    w = F.when(F.col("variant") == "full", o.w_full).otherwise(o.w_obj) * F.when(F.col("channel") == "title", o.w_title).when(F.col("channel") == "desc", o.w_desc).otherwise(o.w_specs)
    parts = lists.withColumn("part", w * F.col("sim"))
    return (parts if cand is None else cand.join(parts, ["query_id", "row_id"], "left")).groupBy("query_id", "row_id").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("sem"))


def search(queries: DataFrame, query_vectors: DataFrame, meta: DataFrame, vectors: DataFrame, numbers: DataFrame, schema: DataFrame, aliases: DataFrame, options: SearchOptions = SearchOptions(), unit: bool = False) -> DataFrame:
    """``(query_id, rank, row_id, score, kind)`` and the meta columns; ``kind`` is ``sku`` (rank 0) or ``ranked``.

    ``queries (query_id, text)``; ``query_vectors (query_id, variant full|obj, vec)`` embed the text and its
    ``object_query``; ``unit``: ``vectors`` are of length 1 already.  Every stage is a join or a grouping over all
    queries at once.  What several stages read (constraints, shortlists, lists, candidates) is
    written to the shared folder, so that each stage is planned by itself.  Equal scores to
    9 decimals tie, to the smaller row.

    A query with a shortlist pulls lists of three times its length, so their rows would grow as the square of the
    catalog.  Queries with the same constraints share one shortlist, and of the lists only the ends are found.
    """
    o = options
    cons = hold(constraints(alias_hits(queries, aliases), schema, o.window))
    # with no constraint on a known field every row is on the shortlist
    stated = cons.where("known").groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("field_id", "value", "tau", "tau_boost"))).alias("stated"))
    stated = hold(stated.select("query_id", F.min("query_id").over(Window.partitionBy("stated")).alias("group_id")))
    own_cons = cons.join(stated.where("query_id = group_id").select("query_id"), "query_id", "left_semi")
    fit = hold(shortlist(own_cons, numbers))
    short = hold(fit.join(boosts(own_cons, numbers, fit), ["query_id", "row_id"], "left").withColumnRenamed("query_id", "group_id"))
    base = max(o.pull, 50 * o.k)
    sizes = short.groupBy("group_id").agg(F.greatest(F.lit(base), 3 * F.count("*")).cast("int").alias("pull"))
    wide = hold(stated.join(sizes, "group_id"))
    rest = query_vectors.join(wide.select("query_id"), "query_id", "left_anti").select("query_id", "variant", "vec", F.lit(base).alias("pull"))
    lists = hold(rank_lists(rest, vectors, unit=unit))
    cand = hold(candidates(lists, lists.select("query_id", "row_id").where("false"), stated.select("query_id"), o))
    score = semantic_scores(cand, lists, o).join(boosts(cons, numbers, cand), ["query_id", "row_id"], "left").select("query_id", "row_id", (F.col("sem") + o.w_num * F.coalesce("boost", F.lit(0.0))).alias("score"))
    sku = hold(sku_matches(queries, meta, 1, o.sku_cutoff).select("query_id", F.lit(0).alias("rank"), "row_id", F.col("ratio").alias("score"), F.lit("sku").alias("kind"), "norm"))
    # rows of a query's own SKU are no answers, so as many more are asked for
    named = small(sku.join(wide.select("query_id"), "query_id", "left_semi").select("query_id", "norm"))
    named = named.join(meta.select(sku_form(F.col("sku")).alias("norm")), "norm").groupBy("query_id").agg(F.count("*").alias("n"))
    asked = hold(wide.join(named, "query_id", "left").select("query_id", "group_id", (F.lit(o.k) + F.coalesce("n", F.lit(0))).alias("most")))
    ends = hold(list_ends(query_vectors.select("query_id", "variant", "vec").join(wide.select("query_id", "pull"), "query_id"), vectors, unit=unit))
    score = score.unionByName(shortlist_best(asked, short, query_vectors, vectors, ends, o, unit))
    shown = score.join(meta.select("row_id", sku_form(F.col("sku")).alias("own")), "row_id").join(sku.select("query_id", "norm"), "query_id", "left").where("norm is null or own != norm")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "row_id"))
    ranked = shown.withColumn("rank", rank).where(F.col("rank") <= o.k).select("query_id", "rank", "row_id", "score", F.lit("ranked").alias("kind"))
    shape = meta.withColumn("description", F.substring("description", 1, 220))
    return sku.drop("norm").unionByName(ranked).join(shape, "row_id")


__all__ = ["SearchOptions", "search", "sku_matches", "alias_hits", "near_scalar", "constraints", "shortlist", "boosts", "rank_lists", "list_ends", "shortlist_best", "candidates", "semantic_scores", "object_query"]
