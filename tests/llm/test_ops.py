"""Operators against brute force on small tables, with the odd cases each defines."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import bpe, graph, license_scan, line_dedup, minhash, mixing, quality_classifier, quality_rules, queries, shingles, topk, url_filter

from ..oracle import SF, same_rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "Ünïcode ΑΣ  İstanbul x y", "<|endoftext|> in <|startoftext|>text", "don't  stop\t\n now!!", "x" * 3000, "日本語テキスト 👩‍👩‍👧 é", "\x1c\x1d a\x00b", "1234567 3.14 ½ ⅷ", "  lead and trail  ", "A\r\nB"]


def documents(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("k", "t", "row", "path", "cid", "block", "lines", "cut", "stratum", "size", "label"):  # names used inside
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.SQL[name])


def test_topk_brute(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(20)]) for i in range(300)]
    rows += [(300, rows[0][1]), (0, rows[0][1]), (301, None), (302, [1.0, None]), (303, [math.nan] * 20), (304, [math.inf] * 20), (None, rows[1][1]), (350, [0.5, 0.25]), (351, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in good if c != q and len(a) == len(b))[:5]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.where("false")).count() == 0


def test_bpe_equals_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    texts = ODD + [r.text for r in docs]
    df = documents(spark, texts)
    for path, check in ((WORDS, "ids"), (BYTES, "count")):
        lib = Tokenizer.from_file(path)
        lib.no_truncation(), lib.no_padding()
        want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        if check == "ids":
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            got = {r.doc_id: r for r in bpe.round_trip_digests(df, path).collect()}
            for i, ids in enumerate(want):
                assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))), repr(texts[i])[:80]
            enc = bpe.encode_documents(df, path)
            assert {r.doc_id: r.ids for r in enc.collect()} == dict(enumerate(want))
            dec = {r.doc_id: r.decoded for r in bpe.decode_documents(enc, path).collect()}
            assert dec == {i: lib.decode(ids, skip_special_tokens=False) for i, ids in enumerate(want)}
        else:
            got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.token_counts(df, path).collect()}
            assert got == {i: (len((t or "").encode()), len(w), len(w) > 1024) for i, (t, w) in enumerate(zip(texts, want))}
    assert bpe.token_counts(df.where("false"), BYTES).count() == 0


def test_merges_agree():
    rng = random.Random(1)
    ranks = {a << 32 | b: r for r, (a, b) in enumerate(rng.sample([(a, b) for a in range(12) for b in range(12)], 60))}
    merged = [rng.randrange(12) for _ in ranks]

    def naive(ids):
        ids = list(ids)
        while True:
            found = [(ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in ranks]
            if not found:
                return ids
            r, i = min(found)
            ids[i : i + 2] = [merged[r]]

    words = [[rng.randrange(12) for _ in range(rng.randrange(0, 60))] for _ in range(300)]
    many = bpe.segment_merge_many([w for w in words if len(w) > 1], bpe.RankTable(ranks), np.array(merged))
    assert many == [naive(w) for w in words if len(w) > 1]
    for w in words:
        assert bpe.segment_merge(list(w), ranks, merged) == naive(w)
        assert bpe.heap_count(list(w), ranks, merged) == len(naive(w))


def shingles_of(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                w.append(cur)
            cur = ""
        else:
            cur += c
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts, num=85):
    sets, up = [shingles_of(t) for t in texts], list(range(len(texts)))
    root = lambda x: x if up[x] == x else root(up[x])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), root(i), root(i) == i) for i, s in enumerate(sets)]


def near_texts(n_base=12, copies=12, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    out = []
    for b in range(n_base):
        base = [word() for _ in range(rng.randrange(3, 160))] + (shared if b % 2 else [])
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if rng.random() < 0.2 else "\n".join(w))
    return out


def test_minhash_brute(spark):
    texts = near_texts() + ["", None, " \t", "one two", "ONE\ttwo", "one two three"]
    df = documents(spark, texts)
    assert sorted(map(tuple, minhash.near_components(df).collect())) == brute_components(texts)
    assert minhash.near_components(df.where("false")).count() == 0
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _, k in brute_components(texts) if k}


def test_minhash_large_nodes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    texts = near_texts(6, 25, 8)
    assert sorted(map(tuple, minhash.near_components(documents(spark, texts)).collect())) == brute_components(texts)


def test_minhash_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, "z y x w v u")], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_components(df).collect()), key=repr)
    assert got == sorted([(2, 2, 2, True), (5, 2, 2, False), (5, 2, 2, False), (9, 2, 9, True), (None, 2, None, True)], key=repr)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (1, 0)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in list(up)} and len(got) == len(up)
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, want, out = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: want * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            want -= out[s]
        left -= over
    return out


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * (rng.randrange(1, 300) if i % 9 else 40)), rng.choice(["a", "a", "a", "é", "Z", None])) for i in range(900)] + [(900, None, "a"), (901, "", "empty"), (902, "x y", "tiny"), (902, "x y", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(0))
    out = mixing.mix_sources(df)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(df.repartition(3)).collect()), key=repr)
    src, sizes, taken = {i: s for i, _, s in rows}, {}, {}
    for r in got:
        sizes[src[r.doc_id]] = sizes.get(src[r.doc_id], 0) + r["size"]
        taken[src[r.doc_id]] = taken.get(src[r.doc_id], 0) + r.taken
        assert r.taken == r["size"] * r.copies <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[src[r.doc_id]] and r.target == pytest.approx(want[src[r.doc_id]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 300
    mixed = mixing.mixed_rows(df, out)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_sources(df.where("false")).count() == 0


def test_quality_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.score_quality(docs, model).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    y = {r.doc_id: r.quality for r in labels.collect() if got[r.doc_id].held_out}
    good, bad = [got[i].score for i in y if y[i]], [got[i].score for i in y if not y[i]]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97
    # held-out labels and other columns don't matter
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.score_quality(docs.withColumn("lang", F.lit("x")), quality_classifier.train(docs.withColumn("source", F.lit("y")), turned))
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in got.items()}
    odd = documents(spark, ODD)
    assert quality_classifier.score_quality(odd, model).count() == len(ODD) and quality_classifier.keep_good(odd, model, 0.0).columns == odd.columns
    assert quality_classifier.train(docs.where("false"), labels) == {} and {r.score for r in quality_classifier.score_quality(odd, {}).collect()} == {0.5}


def test_quality_rules_measures(spark):
    texts = ODD + ["a b c d e f g h i\n" * 5, "x\nx \nx\n\ny\ny", "#a *b $ | <&>", " ".join(map(str, range(40))) + " " + " ".join(map(str, range(12)))]
    got = {r.doc_id: r for r in quality_rules.measures(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        wins = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        cover = {j + d for j, x in enumerate(wins) if wins.count(x) > 1 for d in range(8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)), repr(t)[:60]


def test_binomial_tail(spark):
    cases = [(0, 0), (10, 0), (1000, 3), (500, 4), (50, 49), (300, 2)]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for r in got:
        want = 1.0 if r.k >= r.n * 0.01 else sum(math.comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-9)


def rule_tables(spark):
    """Three strata: one with many labels and symbols in bad texts, one with long words in good ones, one with few labels."""
    rows, labels = [], []
    add = lambda text, lang, q: (rows.append((len(rows), text, lang)), labels.append((rows[-1][0], q)))
    for i in range(400):
        add(" ".join(f"word{(i * 7 + j) % 997}" for j in range(60)), "en", 1)
        add(" ".join(f"wort{'lang' * (i % 10 == 0)}{(i * 7 + j) % 997}" for j in range(60)), "de", 1)
    for i in range(40):
        add(" ".join(f"v{j}{i} ##" for j in range(30)), ("en", "de", None)[i % 3], 0)
        add(" ".join(f"mot{i}x{j}" for j in range(30)), "fr", 1)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_certify_and_equal_sql(spark):
    docs, labels = rule_tables(spark)
    shares = quality_rules.with_shares(quality_rules.measures(docs)).withColumn("step", quality_rules.rejecting_step())
    steps = {r.stratum: r for r in quality_rules.certified_steps(shares, labels).collect()}
    path = quality_rules.tightening()
    assert set(steps) == {"en", "de"} and steps["en"].n == 400 and steps["en"].step > steps["de"].step and steps["de"].cutoffs.asDict() == path[steps["de"].step]
    out = quality_rules.judge_quality(docs, labels)
    lost = {s: sum(not r.kept for r in out.collect() if r.stratum == s) for s in ("en", "de", "fr", "")}
    assert lost["en"] == 14 and lost["de"] >= 13 and lost["fr"] == lost[""] == 0  # where nothing is certified, no rule applies
    con = duckdb.connect()
    con.register("documents", docs.toPandas()), con.register("labels", labels.toPandas())
    got = con.execute(queries.SQL["op8_quality_rules"])
    names = [d[0] for d in got.description]
    assert sorted(map(repr, (tuple(r[names.index(c)] for c in out.columns) for r in got.fetchall()))) == sorted(repr(tuple(r)) for r in out.collect())


def test_rules_fixed_sequence_by_hand(spark):
    docs, labels = rule_tables(spark)
    shares = quality_rules.with_shares(quality_rules.measures(docs)).collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    for s, row in {r.stratum: r for r in quality_rules.certified_steps(quality_rules.with_shares(quality_rules.measures(docs)).withColumn("step", quality_rules.rejecting_step()), labels).collect()}.items():
        own = [r for r in shares if r.stratum == s and r.doc_id in good and not r.base_failed]
        passed = []
        for at in quality_rules.tightening():
            k = sum(any((r[m] > at[name]) if high else (r[m] < at[name]) for name, m, high, _ in quality_rules.RULES) for r in own)
            passed.append(sum(math.comb(len(own), j) * 0.05**j * 0.95 ** (len(own) - j) for j in range(k + 1)) <= 0.05 / 3)
        assert row.step == (passed + [False]).index(False) - 1


def test_rules_odd_tables(spark):
    docs, labels = rule_tables(spark)
    none = quality_rules.judge_quality(docs, labels.where("false")).collect()
    assert len(none) == docs.count() and all(r.kept == (not r.base_failed) for r in none)
    assert quality_rules.judge_quality(docs.where("false"), labels).count() == 0
    odd = documents(spark, ODD).drop("stratum").unionByName(documents(spark, ODD).drop("stratum")).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    got = quality_rules.judge_quality(odd, labels.unionByName(labels)).collect()
    assert len(got) == 2 * len(ODD) and sum(r.doc_id is None for r in got) == 8
    long = spark.createDataFrame([(1, "ab cd ef gh ij " * 60_000, "en")], "doc_id long, text string, lang string")
    assert tuple(quality_rules.judge_quality(long, labels).first())[1:3] == (300_000, 600_000)


def test_line_dedup(spark):
    para = "alpha one\nbeta two\ngamma three\ndelta four"
    texts = [para, "intro\n" + para + "\nend", "alpha one\nbeta two", "x\nalpha one\n\n beta two \ngamma three\ny", None, "", "a\na\na\na\na\nb"]
    df = documents(spark, texts)
    got = {r.doc_id: (r.text, r["lines"].total, r["lines"].removed) for r in line_dedup.dedup_lines(df.drop("lines")).collect()}
    clash = line_dedup.dedup_lines(df)
    assert clash.columns == [*df.columns, "lines_"] and {r.doc_id: r.text for r in clash.collect()} == {i: x[0] for i, x in got.items()}
    twice = df.drop("lines").unionByName(df.drop("lines")).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    again = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(twice).collect()]
    assert sorted(again, key=repr) == sorted([(i, x[0]) for i, x in got.items() if i != 3] * 2 + [(None, got[3][0])] * 2, key=repr)
    long = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(30_000))), (2, "\n".join(f"line {i}" for i in range(29_990, 30_010)))], "doc_id long, text string")
    assert [r["lines"].removed for r in line_dedup.dedup_lines(long).orderBy("doc_id").collect()] == [0, 10]
    assert got[0] == (para, 4, 0) and got[1] == ("intro\nend", 6, 4) and got[2] == (texts[2], 2, 0)
    assert got[3] == ("x\ny", 6, 4) and got[4] == (None, 0, 0) and got[5] == ("", 1, 0) and got[6] == ("a\nb", 6, 4)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.example.org/x", link.format("http://spam.net/es/1")), (2, "http://b.org/", '<meta http-equiv="refresh" content="0; url=http://a.example.org/x#f">'), (3, "http://b.org/", None),
        (4, "https://spam.net/es/1", None), (5, "http://c.org/p?q", link.format("//www.example.com/en/z")), (6, "http://d.org/", link.format("http://c.org/p?q")), (7, "http://d.org/", link.format("http://spam.net/fr/")),
        (8, "HTTP://WWW.Example.COM/en/y", None), (9, "http://example.com/en/y", None), (10, "http://x.com", None), (11, "nope", None), (12, None, link.format("http://spam.net/fr/")), (None, "http://net/es/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("node", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, url_filter.page_edges(df)).collect()}
    assert got[1][3] == got[2][3] == got[3][3] == "block" and got[4] == ("spam.net", "/es/1", "net/es/", "block")
    assert got[5] == ("c.org", "/p", None, "allow") and got[6][3] == got[7][3] == "allow"  # an allowed alias outweighs a blocked one
    assert got[8] == ("www.example.com", "/en/y", "www.example.com/en/", "allow") and got[9][2:] == ("example.com/en/", "block")
    assert got[10] == ("x.com", "", None, "allow") and got[11] == ("", "", None, "allow") and got[12] == ("", "", None, "allow") and got[None][3] == "block"
    assert url_filter.judge_urls(df.where("false"), url_filter.page_edges(df.where("false"))).count() == 0


def test_url_filter_equals_sql_with_links(spark):
    link, jump = '<head>{}<link href="{}" rel=canonical></head>', "<meta http-equiv=Refresh content='3; URL={}'>"
    base = '<base href="http://hub.org/dir/sub/page?x">'
    rows = [
        ("http://hub.org/dir/a", link.format("", "b?q=1#f")), ("http://hub.org/dir/b?q=1", jump.format("../up/./c")), ("http://hub.org/up/c", link.format("", "http://spam.net/es/z")),
        ("http://lone.org", link.format("", "?id=3")), ("http://lone.org/?id=3", jump.format("//ok.com")), ("http://x.org/1", link.format(base, "../y")), ("http://hub.org/dir/y", jump.format("http://q.net/fr/")),
        ("http://m.org/", link.format("", "mailto:a@b.c")), ("http://n.org/a/b", link.format("", "..")), ("http://n.org/", jump.format("http://q.net/fr/")), ("http://o.org/", link.format("", "#top")), ("nothing", jump.format("x")), (None, None), ("", ""),
    ]
    rows = [(i, u, h) for i, (u, h) in enumerate(rows * 2)] + [(None, "http://hub.org/dir/a", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = url_filter.judge_urls(df, url_filter.page_edges(df))
    verdicts = {r.page_id: r.verdict for r in out.collect()}
    assert [verdicts[i] for i in range(14)] == ["block"] * 3 + ["allow"] * 2 + ["block"] * 2 + ["allow"] + ["block"] * 2 + ["allow"] * 4 and verdicts[None] == "block"
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    got = con.execute(queries.SQL["op7_url_filter"])
    names = [d[0] for d in got.description]
    assert sorted(map(repr, (tuple(r[names.index(c)] for c in out.columns) for r in got.fetchall()))) == sorted(repr(tuple(r)) for r in out.collect())


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[2][1]
    texts = ["intro text\n  RELEASED under the MIT license!!\nmore", mit, None, "", "nothing here", mit + "\n" + license_scan.TEMPLATES[4][1]]
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert got[0] == ("MIT", 2, 1.0, 1, 1) and got[1] == ("MIT", 2, 1.0, 0, 1) and got[2] == got[3] == got[4] == (None, None, 0.0, None, 0)
    assert got[5][:4] == ("MIT", 2, 1.0, 0) and got[5][4] == 3  # the whole text is near the second notice
    assert license_scan.scan_licenses(documents(spark, texts), templates=()).where("license is not null").count() == 0


def brute_line_dedup(rows):
    """``{doc_id: text}`` of ``(doc_id, text)`` rows in order of ids, without later windows of three lines."""
    seen, out = set(), {}
    for i, text in rows:
        lines = (text or "").split("\n")
        held = [(j, x.strip(" \t\n\x0b\x0c\r")) for j, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for w in zip(held, held[1:], held[2:]):
            key = tuple(x for _, x in w)
            if key in seen:
                gone.update(range(w[0][0], w[2][0] + 1))
            seen.add(key)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text
    return out


def tilted_rates(sizes, target, cap=2.0):
    """The entropy-balanced rate of each size, by bisection of the dual; an independent solution."""
    total, mean = sum(sizes), sum(sizes) / len(sizes)
    if target >= cap * total:
        return lambda x: cap
    rate = lambda lam, x: min(cap, math.exp(min(lam * x / mean, 1.0)))
    low, high = -1e4, 1e4
    for _ in range(300):
        at = (low + high) / 2
        low, high = (at, high) if sum(x * rate(at, x) for x in sizes) < target else (low, at)
    return lambda x: rate(low, x)


def held_to_tilted_rates(rows):
    """Copies by size of ``(source, size, copies)`` rows follow the tilted rates: words taken from the largest size on are off by a document at most, unless all smaller ones are full or out."""
    by = {}
    for s, x, c in rows:
        if x:
            by.setdefault(s, []).append((x, c))
    want = brute_targets({s: sum(x for x, _ in v) for s, v in by.items()} | {s: 0 for s, x, _ in rows if s not in by})
    for s, docs in by.items():
        rate, off = tilted_rates([x for x, _ in docs], want[s]), 0.0
        for x in sorted({x for x, _ in docs}, reverse=True):
            own = [c for y, c in docs if y == x]
            off += x * (sum(own) - len(own) * rate(x))
            assert abs(off) <= x + 1e-6 * want[s] or all(c == (2 if off < 0 else 0) for y, c in docs if y < x), (s, x, off)
            assert max(own) - min(own) <= 1


def test_mixing_follows_tilted_rates(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1) + 1)), rng.choice("aaaabc")) for i in range(1500)] + [(2000 + i, "w " * 25, "c") for i in range(300)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    held_to_tilted_rates([(source[r.doc_id], r["size"], r.copies) for r in out])
    # the same ids in another order and partitioning take the same
    assert len({r.copies for r in out}) == 3


def test_pipeline_stages(spark):
    """Each stage of the pipeline over its own input against brute force."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = [docs]
    for name, stage in p.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name.replace(' ', '-')}"
        stage(spark, held[-1], SF).write.mode("overwrite").parquet(path)
        held.append(spark.read.parquet(path))
    assert all(h.columns == docs.columns for h in held[:-1])
    rows = [sorted(map(tuple, h.collect())) for h in held[:-1]]
    model = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows[1] == [r for r in rows[0] if quality_classifier.score_texts(pa.array([r[1]]), model)[0] >= 0.3]
    text = brute_line_dedup([(r[0], r[1]) for r in rows[1]])
    assert [(r[0], r[1], r[2], r[3]) for r in rows[2]] == [(r[0], text[r[0]], r[2], r[3]) for r in rows[1]]
    assert all(r[4] == (r[4] if text[r[0]] == r[1] else len(text[r[0]])) for r in rows[2])
    want = brute_components([r[1] for r in rows[2]], 80)
    assert rows[3] == [rows[2][i] for i, _, _, k in want if k]
    n = Counter(rows[4])
    assert set(n) <= set(rows[3])
    held_to_tilted_rates([(r[3], len([w for w in re.split("[ \t\n\x0b\x0c\r]+", r[1] or "") if w]), n[r]) for r in rows[3]])
    lib = Tokenizer.from_file(WORDS)
    ids = {r[0]: lib.encode(r[1] or "", add_special_tokens=False).ids for r in rows[4]}
    got = held[5].collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows[4])
    for r in got:
        assert list(r.ids) == ids[r.doc_id] and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(lib.decode(r.ids, skip_special_tokens=False).encode()).hexdigest()


def test_nnpu_risk_brute():
    rng, signs = np.random.default_rng(2), set()
    for prior, shift in ((0.3, 0.0), (0.9, 0.0), (0.8, 6.0)):  # the last has a negative second term
        fp, fu = rng.normal(1 + shift, 1, 40), rng.normal(-shift, 1, 70)
        plus = [math.log1p(math.exp(-x)) for x in fp]
        part = sum(math.log1p(math.exp(x)) for x in fu) / 70 - prior * sum(math.log1p(math.exp(x)) for x in fp) / 40
        risk, gp, gu = quality_classifier.nnpu_risk(fp, fu, prior)
        assert risk == pytest.approx(prior * sum(plus) / 40 + max(0, part))
        signs.add(part < 0)
        # the gradient of the risk where it is not clipped, else of the clipped term the other way
        goal = lambda p, u: (prior * np.logaddexp(0, -p).mean() if part >= 0 else 0) + (1 if part >= 0 else -1) * (np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())  # noqa: B023, E731
        for i in range(5):
            step = np.eye(40)[i] * 1e-6
            assert gp[i] == pytest.approx((goal(fp + step, fu) - goal(fp - step, fu)) / 2e-6, abs=1e-7)
            step = np.eye(70)[i] * 1e-6
            assert gu[i] == pytest.approx((goal(fp, fu + step) - goal(fp, fu - step)) / 2e-6, abs=1e-7)
    assert signs == {False, True}


def test_prior_and_model_need_no_negatives(spark):
    rng = np.random.default_rng(4)
    positive = rng.normal(2, 1, (900, 6))
    for share in (0.3, 0.7):
        unlabelled = np.where(rng.random((3000, 1)) < share, rng.normal(2, 1, (3000, 6)), rng.normal(-2, 1, (3000, 6)))
        assert quality_classifier.estimate_prior(positive, unlabelled) == pytest.approx(share, abs=0.06)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality_classifier.train(docs, labels), quality_classifier.train(docs.repartition(3), labels.where("quality = 1"))
    assert a["prior"] == b["prior"] and all((x == y).all() for p, q in zip(a["layers"], b["layers"]) for x, y in zip(p, q))


def test_classifier_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(docs.unionByName(docs.limit(20)), labels.unionByName(labels))
    odd = documents(spark, [*ODD, "word " * 400_000]).unionByName(documents(spark, ODD)).withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id")))
    got = quality_classifier.score_quality(odd, model).collect()
    assert len(got) == 2 * len(ODD) + 1 and all(r.held_out for r in got if r.doc_id is None) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score_quality(odd.where("false"), model).count() == 0


def test_word_hashes_tell_pattern_words_apart():
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: 98, 98: 97})
        both = pa.array([word, word.translate({97: 98, 98: 97})])
        hashes, counts = shingles.word_hashes(*shingles.raw_bytes(both))
        assert counts.tolist() == [1, 1] and hashes[0] != hashes[1]
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB é\n\t") for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", "x" * 100]
    words = [[w for w in re.split("[ \t\n\x0b\x0c\r]+", (t or "").replace("B", "b")) if w] for t in texts]
    for chunk in (64, 1 << 20):
        shingles_chunk, shingles.CHUNK = shingles.CHUNK, chunk
        try:
            hashes, counts = shingles.word_hashes(*shingles.raw_bytes(pa.array(texts)))
        finally:
            shingles.CHUNK = shingles_chunk
        told = dict(zip([w for ws in words for w in ws], hashes.tolist()))
        assert counts.tolist() == list(map(len, words)) and [told[w] for ws in words for w in ws] == hashes.tolist() and len(set(told.values())) == len(told)


def test_tokenizer_refuses_unknown_parts():
    spec = json.loads(open(WORDS, "rb").read())
    bpe.refuse_unknown(spec), bpe.refuse_unknown(json.loads(open(BYTES, "rb").read()))
    changes = [("model", spec["model"] | {"type": "WordPiece"}), ("model", spec["model"] | {"byte_fallback": True}), ("normalizer", {"type": "NFKC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("post_processor", {"type": "TemplateProcessing"}), ("added_tokens", [spec["added_tokens"][0] | {"lstrip": True}])]
    for key, value in changes:
        with pytest.raises(ValueError):
            bpe.refuse_unknown(spec | {key: value})
    with pytest.raises(ValueError):
        bpe.Tokenizer(open(BYTES, "rb").read()).decode([1])


def test_bpe_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    for got in (bpe.round_trip_digests(df, WORDS), bpe.token_counts(df, BYTES)):
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == 4 and rows[0] == rows[1] and rows[2][0] is None and rows[2][1:] == rows[0][1:] and rows[3][0] is None
