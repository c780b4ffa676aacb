"""What grows with the tables: rows that meet, plans that repeat a table, tasks that share a small file."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import search
from gristmill.plans import queries
from gristmill.sources import held

from .oracle import SF


def test_candidates_read_the_catalog_once(spark):
    """The parsing of every part stood in the plan once for each use of the shortlist."""
    plan = queries.candidate_union(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "p_name" not in plan


def test_lists_send_few_winners_and_equal_brute_force(spark):
    """Blocks are of rows of one channel; more than a block's rows may be asked for."""
    ids = spark.range(3000).select("id", F.array(*[F.sin(F.col("id") % 700 * (i + 1)).cast("float") for i in range(4)]).alias("vec"))
    vectors = ids.select(F.col("id").alias("row_id"), F.explode(F.array(F.lit("title"), F.lit("desc"))).alias("channel"), "vec")
    asked = ids.where("id < 130").select(F.col("id").alias("query_id"), F.lit("full").alias("variant"), "vec", F.when(F.col("id") == 0, 1000).otherwise(5).alias("pull"))
    got = search.rank_lists(asked, vectors, ("title", "desc"), block_rows=700).collect()
    small = search.rank_lists(asked, vectors, ("title", "desc")).collect()
    assert sorted(got) == sorted(small) and len(got) == 2 * (1000 + 129 * 5)
    one = [r.row_id for r in sorted(got, key=lambda r: r.rank) if (r.query_id, r.channel) == (3, "desc")]
    assert one == [3, 703, 1403, 2103, 2803]


def test_a_large_held_table_is_not_broadcast(spark):
    """A million ids and few values are files of a few MB, which was taken for their size."""
    ids = spark.range(200_000).select("id", (F.col("id") % 50).alias("v"))
    few = spark.range(30).withColumnRenamed("id", "v")
    assert "Broadcast" not in held.hold(ids).join(held.hold(ids), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in held.hold(ids).join(F.broadcast(few), "v")._jdf.queryExecution().executedPlan().toString()


def test_near_rows_by_brute_force(spark):
    """Bands over bins of several widths, edges met exactly, absent fields, doubles too coarse for the band and bands without end."""
    rng = random.Random(7)
    inf = float("inf")
    rows = {(i, f): rng.choice([0.0, 1.0, -0.0625, 0.0625, 2.5, 1e15, 1e15 + 1, inf, -3.0, rng.uniform(-9, 9)]) for i in range(60) for f in "abc" if rng.random() < 0.8}
    cons = [(q, f, rng.choice([0.0, 1.0, 2.5, -3.0, 1e15, inf, rng.uniform(-9, 9)]), rng.choice([0.0625, 0.5, 3.0, 1e-9, 7.0, inf]), rng.random() < 0.9) for q in range(150) for f in rng.sample("abca", rng.randint(1, 3))]
    c = spark.createDataFrame([(q, f, v, t, t, k) for q, f, v, t, k in cons], "query_id long, field_id string, value double, tau double, tau_boost double, known boolean")
    n = spark.createDataFrame([(i, f, x) for (i, f), x in rows.items()], "row_id long, field_id string, value double")
    of = lambda q: [x for x in cons if x[0] == q and x[4]]
    want = {(q, i) for q in range(150) for i in range(60) if of(q) and all((i, f) in rows and abs(rows[i, f] - v) <= t for _, f, v, t, _ in of(q))}
    assert sorted(map(tuple, search.shortlist(c, n).collect())) == sorted(want) and len(want) > 100
    joined = {tuple(r)[:2]: r.boost for r in search.boosts(c, n, spark.createDataFrame(sorted(want), "query_id long, row_id long")).collect()}
    assert {(r.query_id, r.row_id): r.boost for r in search.near_rows(c, n, c).collect()} == pytest.approx(joined, nan_ok=True)


def test_pairs_of_a_band_are_not_shuffled(spark):
    """Queries and rows met by field, so every constraint met every row."""
    for name in ("numeric_boost", "tolerance_shortlist"):
        text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in text[: text.index("Join")]


def test_pairs_of_a_catalog_are_never_broadcast(spark):
    """The file of a catalog is small enough, and keys made in Python seemed larger, so all pairs went by way of the driver."""
    plan = queries.numeric_long(spark, SF)._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in plan.splitlines() if "BroadcastHashJoin" in x)
    assert "BuildRight" in join and "norm" in join


def test_sku_block_by_brute_force():
    """Every form was scored for every query; now few are, with the same best ones and the same ties."""
    rng = random.Random(3)
    word = lambda signs, lo, hi: "".join(rng.choice(signs) for _ in range(rng.randint(lo, hi)))
    for signs, lo, hi in (("01", 1, 12), ("AB0127", 3, 24), (search.SKU_SIGNS, 1, 44), ("A0", 20, 44)):
        norms = sorted({word(signs, lo, hi) for _ in range(600)})
        block = search.SkuBlock(norms, list(range(len(norms))))
        for q in [word(signs, 4, 24) for _ in range(12)] + [x + "7" for x in norms[:8] if 3 < len(x) < 24]:
            for n, cutoff in ((1, 0.7), (3, 0.7), (5, 0.4)):
                every = [(difflib.SequenceMatcher(None, x, q).ratio(), x, i) for i, x in enumerate(norms)]
                assert block.best(q, n, cutoff) == sorted((x for x in every if x[0] >= cutoff), reverse=True)[:n]


def test_search_finds_only_the_ends_of_lists(spark, monkeypatch):
    """Lists of three times the shortlist were pulled for each query; the answers stay those of the lists, by brute force."""
    rng = np.random.default_rng(5)
    n, o = 1500, search.SearchOptions(k=2, pull=10)
    size = rng.integers(0, 5, n)
    size[:2] = 9  # a shortlist on none of the lists
    vec = {c: rng.integers(0, 3, (n, 4)).astype(np.float64) for c in search.CHANNELS}
    vec["desc"][:] = 1.0  # all rows tie
    vec["title"][:2], vec["specs"][:2], vec["title"][5:], vec["specs"][-40:] = 0.0, 0.0, vec["title"][5:] + 0.25, 0.0
    held = [(i, c, vec[c][i].tolist()) for c in search.CHANNELS for i in range(n) if c != "desc" or i > 1]
    vectors = spark.createDataFrame(held, "row_id long, channel string, vec array<double>")
    asks = {q: (rng.integers(0, 4, (2, 4)) + 1.0, [9, 0, 1, 2, 3, 0][q % 6]) for q in range(12)}
    queries = spark.createDataFrame([(q, f"a part of size {s} in") for q, (_, s) in asks.items()], "query_id long, text string")
    asked = spark.createDataFrame([(q, v, x.tolist()) for q, (xs, _) in asks.items() for v, x in zip(("full", "obj"), xs)], "query_id long, variant string, vec array<double>")
    numbers = spark.createDataFrame([(i, "size", float(s)) for i, s in enumerate(size)], "row_id long, field_id string, value double")
    schema = spark.createDataFrame([("size", "length")], "field_id string, family string")
    meta = spark.createDataFrame([(i, f"S{i}", "") for i in range(n)], "row_id long, sku string, description string")
    pulls, block_rows = [], search.block_lists
    monkeypatch.setattr(search, "rank_lists", lambda q, *a, f=search.rank_lists, **b: (pulls.append(q.agg({"pull": "max"}).first()[0]), f(q, *a, **b))[1])
    monkeypatch.setattr(search, "block_lists", lambda q, v, c, rows=0, unit=False, components=0: block_rows(q, v, c, 300, unit))
    monkeypatch.setattr(search, "ID_BITS", 5)
    got = search.search(queries, asked, meta, vectors, numbers, schema, spark.createDataFrame([("size", "size")], "text string, field_id string"), o).collect()
    assert all(p is None or p <= 100 for p in pulls)
    unit = lambda x: x / (np.sqrt((x * x).sum(-1, keepdims=True)) + 1e-12)
    weights = {"title": o.w_title, "desc": o.w_desc, "specs": o.w_specs}
    want = []
    for q, (xs, s) in asks.items():
        short = np.flatnonzero(abs(size - s) <= 0.0625)
        sem, met = np.zeros(n), np.zeros(n, bool)
        for w, x in zip((o.w_full, o.w_obj), xs):
            for c in search.CHANNELS:
                ids = np.arange(2 if c == "desc" else 0, n)
                sim = np.round(unit(vec[c][ids]) @ unit(x), 12)
                top = np.lexsort((ids, -sim))[: max(100, 3 * len(short))]
                sem[ids[top]] += w * weights[c] * sim[top]
                met[ids[top]] = True
        some = short[met[short]] if met[short].any() else short
        score = sem[some] + o.w_num
        order = np.lexsort((some, -np.round(score, 9)))[: o.k]
        want += [(q, rank, int(some[i]), round(float(score[i]), 6)) for rank, i in enumerate(order, 1)]
    assert sorted((r.query_id, r["rank"], r.row_id, round(r.score, 6)) for r in got) == want


def test_a_form_that_is_there_is_found_without_looking_at_others(spark, monkeypatch):
    """Every query was held against every form, also one whose own form is among them."""
    meta = spark.createDataFrame([(i, f"AB-{i}") for i in range(1000, 1100)], "row_id long, sku string")
    asked = spark.createDataFrame([(i, f"ab{i}") for i in range(1000, 1040)], "query_id long, text string")
    monkeypatch.setattr(search, "SkuBlock", None)
    got = search.sku_matches(asked, meta).collect()
    assert sorted((r.query_id, r.row_id, r.ratio) for r in got) == [(i, i, 1.0) for i in range(1000, 1040)]
