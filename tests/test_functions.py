import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text, values

# value, kind, unit, family, reason, value
CASES = [
    ("3/8 In in", "scalar", "in", "length", "scalar_known_unit", 0.375), ("10/32", "scalar", "", None, "scalar_unitless", 0.3125), ("0.2 lbs", "scalar", "lb", "mass", "scalar_known_unit", 0.2),
    ('5/8"', "scalar", "in", "length", "scalar_known_unit", 0.625), ("2.5mm", "scalar", "mm", "length", "scalar_known_unit", 2.5), ("40 ft", "scalar", "ft", "length", "scalar_known_unit", 40.0),
    ("300 psi", "scalar", "psi", "pressure", "scalar_known_unit", 300.0), ("74 CFM", "scalar", "cfm", "flow", "scalar_known_unit", 74.0), ("100", "scalar", "", None, "scalar_unitless", 100.0),
    (".7415 in", "unknown", "", None, "no_scalar_match", None), ("2-3/4 in", "range", "", None, "range_like", None), ("1-1/8 – 1-9/16 in", "range", "", None, "range_like", None),
    ("0 - 100 Ft. Lbs. lb-ft", "range", "", None, "range_like", None), ("12-24 VDC V", "range", "", None, "range_like", None), ("M10 x 1.5", "thread", "", "thread", "thread_pattern", None),
    ("200,000 Cycles", "unknown", "", None, "comma_list", None), ("12 x 3/4 in", "unknown", "", None, "no_scalar_match", None), ("10°", "unknown", "", None, "no_scalar_match", None),
    ("208/230 V", "scalar", "v", "voltage", "scalar_known_unit", 208 / 230), ("1 1/2 in", "scalar", "in", "length", "scalar_known_unit", 1.5), ("-5 °C", "scalar", "c", "temperature", "scalar_known_unit", -5.0),
    ("Ø 5 mm", "scalar", "mm", "length", "scalar_known_unit", 5.0), ("1½ in", "scalar", "in", "length", "scalar_known_unit", 1.5), ("5 to 10", "range", "", None, "range_word", None),
    ("1/4-20", "thread", "", "thread", "thread_pattern", None), ("3/4 x", "dual", "", None, "dual_like", None), ("2 in Min", "unknown", "", None, "free_text_tokens", None),
    ("12 AWG", "unknown", "", None, "gauge_or_number_size", None), ("#10", "unknown", "", None, "no_scalar_match", None), ("red & blue", "unknown", "", None, "multi_value_list", None),
    ("1,234 in", "unknown", "", None, "comma_list", None), ("", "unknown", "", None, "empty", None), ("  ", "unknown", "", None, "empty", None), (None, "unknown", "", None, "empty", None),
]


def test_classify(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, v string")
    got = rows.select("i", values.classify(F.col("v")).alias("c"), values.classify(F.col("v"), literal=True)["value"].alias("lit")).orderBy("i").collect()
    for r, (v, kind, unit, family, reason, value) in zip(got, CASES):
        assert (r.c.kind, r.c.unit, r.c.family, r.c.reason) == (kind, unit, family, reason), v
        assert r.c.value == (None if value is None else pytest.approx(value)), v
        assert r.lit is None


def test_conversions(spark):
    cases = [("length", 25.4, "mm", 1.0), ("length", 2.0, "ft", 24.0), ("pressure", 1.0, "bar", 14.5037738), ("mass", 1.0, "kg", 2.20462262), ("power", 1.0, "kw", 1000.0), ("power", 1.0, "hp", 745.699872), ("flow", 1.0, "lpm", 0.264172052), ("flow", 1.0, "cfm", None), ("temperature", 100.0, "c", 212.0), ("voltage", 1.0, "v", None), (None, 3.0, "in", None), (None, 3.0, "", 3.0), ("torque", 1.0, "nm", 0.737562149)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f string, x double, u string, want double")
    for r in df.select("want", values.to_canonical(F.col("f"), F.col("x"), F.col("u")).alias("got")).collect():
        assert r.got == (None if r.want is None else pytest.approx(r.want))


def test_text(spark):
    df = spark.createDataFrame([("  Outer  DIAMETER ",), ("spec_maximum-size_of bolt",), (None,), ("--",)], "t string")
    got = df.select(text.fold(F.col("t")), text.snake_id(F.col("t")), text.title_label(text.snake_id(F.col("t"))), text.human_label(F.col("t"))).collect()
    assert tuple(got[0])[:3] == ("outer diameter", "outer_diameter", "Outer Diameter")
    assert got[1][3] == "Maximum Size of Bolt"
    assert got[2][1] == "field" and got[3][1] == "field" and got[3][2] == "Field"


@pytest.mark.parametrize("q, want", [("I need a ball bearing for a cart", "ball bearing"), ("need the stainless swivel plate caster", "stainless swivel plate"), ("for carts", "for carts"), ("  ", ""), ("wheel", "wheel")])
def test_object_query(spark, q, want):
    assert spark.createDataFrame([(q,)], "q string").select(text.object_query(F.col("q"))).first()[0] == want


def test_sku_and_numbers(spark):
    df = spark.createDataFrame([("ab-12 é", "1-1/2"), ("", "7,000.5"), (None, "x")], "s string, n string")
    got = df.select(text.sku_form(F.col("s")), text.looks_like_sku(F.col("s")), text.parse_number(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("AB12E", True, 1.5), ("", False, 7000.5), ("", False, None)]


def test_tolerance_and_proximity(spark):
    got = spark.range(1).select(*[values.tolerance(F.lit(f), F.lit(g), F.lit(200.0)) for f, g in (("weight_capacity", "mass"), ("load_capacity_range", None), ("x", "length"), ("x", None))], values.proximity(F.lit(1.0), F.lit(1.0), F.lit(0.0)), values.proximity(F.lit(2.0), F.lit(1.0), F.lit(0.5))).first()
    assert list(got) == pytest.approx([1.0, 10.0, 0.0625, 0.25, 1.0, math.exp(-2)])


def test_sku_ratio(spark):
    from gristmill.operators.search import sku_matches

    meta = spark.createDataFrame([(1, "AB-1234"), (2, "AB-1235"), (3, "ab1234"), (4, "ZZZZZZZZZZ"), (5, None)], "row_id long, sku string")
    got = sku_matches(spark.createDataFrame([(9, "ab 12345")], "query_id long, text string"), meta, 5).collect()
    assert [(r["rank"], r.row_id) for r in got] == [(1, 2), (2, 1)]
    for r in got:
        assert r.ratio == difflib.SequenceMatcher(None, r.norm, "AB12345").ratio()


@pytest.mark.parametrize("cutoff", [0.6, 0.7, 0.9])
def test_sku_matches_brute(spark, cutoff):
    from gristmill.operators.search import sku_matches

    rng = random.Random(6)
    skus = ["".join(rng.choice("AB12") for _ in range(rng.randrange(1, 40))) for _ in range(150)] + ["A" * 30, "B1" * 11]
    asked = ["".join(rng.choice("AB12") for _ in range(rng.randrange(4, 25))) for _ in range(25)] + ["A" * 24, "no sku at all, since it is far too long a text"]
    want = []
    for i, q in enumerate(asked):
        near = difflib.get_close_matches(q, list(dict.fromkeys(skus)), n=7, cutoff=cutoff) if " " not in q else []
        want += [(i, r + 1, skus.index(x), x) for r, x in enumerate(near)]
    frame = lambda rows, names: spark.createDataFrame(list(enumerate(rows)), names)
    got = sku_matches(frame(asked, "query_id long, text string"), frame(skus, "row_id long, sku string"), 7, cutoff).select("query_id", "rank", "row_id", "norm").collect()
    assert sorted(map(tuple, got)) == sorted(want)
