import json

import pytest
from pyspark.sql import functions as F

from gristmill.operators import aliases, categorize, channels, embed, harvest, numeric, search
from gristmill.plans import catalog, files
from gristmill.sources import catalog as sources
from gristmill.sources import sinks
from gristmill.streaming.harvest import stream_key_counts

ROWS = [
    (0, "Swivel Caster", "Acme", {"Wheel Diameter": "4 in", "Weight": "2 lbs", "SKU": "AC-1001", "Finish": "Zinc"}),
    (1, "Rigid Caster Acme", "Acme", {"Wheel Diameter": "5 in", "wheel  diameter": "5 in", "Weight": "1 kg", "SKU": "AC-1002"}),
    (2, "Air Motor", "Blow", {"Motor Voltage": "12 V", "Air Flow": "74 CFM", "Thread Size": "1/4-20"}),
    (3, "", "", {"Pressure": "300 psi", "Mixed": "2 in Min", "": "x"}),
    (4, "Broken", "Acme", None),
]


def rows(spark):
    return spark.createDataFrame([(i, n, b, json.dumps(s) if s is not None else "{oops", "vented" if i == 2 else "") for i, n, b, s in ROWS], "row_id long, name string, brand string, specs string, spec_style string")


def test_harvest(spark):
    cells = [(0, '{"a": 1, " a ": "x", "b": null}'), (1, "{'a': 'q'}"), (2, "{'a': \"it's\"}"), (3, None), (4, ""), (5, "[1]"), (6, '{"b": "nan", "c": ""}'), (7, '{"b": "late"}')]
    got = {r.key: (r["count"], r.example) for r in harvest.harvest_keys(spark.createDataFrame(cells, "i long, c string"), "c", "i").collect()}
    assert got == {"a": (3, "1"), "b": (3, "late"), "c": (1, "")}


def test_fields_report_and_warnings(spark):
    m = catalog.mine(rows(spark))
    f = {r.id: r for r in m.fields.collect()}
    assert (f["wheel_diameter"].type, f["wheel_diameter"].unit_family) == ("numeric", "length")
    assert f["wheel_diameter"]["count"] == 3 and len(f["wheel_diameter"].members) == 2
    assert f["wheel_diameter"].aliases[0].text == "Wheel Diameter" and f["wheel_diameter"].aliases[1].confidence == 0.5
    assert f["sku"].path == ["name_pin"] and f["finish"].cat_pin
    assert (f["thread_size"].type, f["thread_size"].unit_family) == ("string", "thread")
    assert f["mixed"].path == ["string_with_violations"] and f["air_flow"].unit_family == "flow"
    lines = {r.line for r in m.warnings.collect()}
    assert any(x.startswith("[violations] id=mixed") for x in lines) and any(x.startswith("[low-support] id=weight") for x in lines)
    assert m.audit.count() == sum(len(r.members) for r in f.values())
    assert m.report.where("id = 'weight'").first().decision.startswith("numeric_all_scalar")


def test_golden_fold(spark):
    raw = spark.createDataFrame([("brand", 5, "x", 0), ("Brand", 9, "y", 1), (" BRAND  ", 1, "", 2), ("", 3, "z", 3)], "key string, count long, example string, ord int")
    (g,) = categorize.key_groups(raw).collect()
    assert (g.signature, g.total, g.canonical, len(g.members)) == ("brand", 15, "Brand", 3)


def test_alias_enrichment(spark):
    e = catalog.mine(rows(spark)).enriched
    owner = {r.text: r.field_id for r in e["aliases"].collect()}
    assert owner["Wheel Diameter"] == "wheel_diameter" and "Wheel OD" not in owner
    assert owner["Wheel Dia"] == "wheel_diameter" and owner["Air CFM"] == "air_flow"
    assert len(owner) == e["aliases"].count()
    dry = aliases.enrich(catalog.mine(rows(spark)).fields.withColumn("ord", F.xxhash64("id")), dry_run=True)
    assert "Wheel Dia" not in {r.text for r in dry["aliases"].collect()} and dry["accepted"].where("source = 'compound_or_base'").count() > 0
    assert {r.reason for r in e["blocked"].collect()} <= {"too_short", "too_long", "bad_charset", "blacklist_token", "bare_acronym_requires_prefix", "not_in_whitelist", "collision_other_field_seed"}


def test_alias_cap_and_first_wins(spark):
    fields = [(0, "wheel_outside_diameter", "Wheel Outside Diameter", "numeric", "length", []), (1, "base_outside_diameter", "Base Outside Diameter", "numeric", "length", [])]
    df = spark.createDataFrame(fields, "ord int, id string, label string, type string, unit_family string, aliases array<struct<text:string>>")
    capped = aliases.enrich(df, max_aliases=1)
    assert {r.field_id: r.added for r in capped["summary"].collect()} == {"wheel_outside_diameter": 1, "base_outside_diameter": 1}
    both = {r.text: r.field_id for r in aliases.enrich(df)["aliases"].collect()}
    assert both["Wheel OD"] == "wheel_outside_diameter" and both["Base OD"] == "base_outside_diameter"


def test_channels(spark):
    got = {r.row_id: r for r in channels.build_channels(rows(spark)).collect()}
    assert got[0].title_text == "Swivel Caster — Acme" and got[1].title_text == "Rigid Caster Acme" and got[3].title_text == "(no title)"
    assert got[0].specs_text == "Finish: Zinc\nSku: AC-1001\nWeight: 2 lbs\nWheel Diameter: 4 in"
    assert got[2].specs_text.splitlines() == ["Air Flow: 74 CFM", "Motor Voltage: 12 V", "Style: vented", "Thread Size: 1/4-20"]
    assert got[4].specs_text == "(no specs)" and got[4].desc_text == "(no description)"


def test_index_numbers(spark):
    index = catalog.build_index(rows(spark), catalog.mine(rows(spark)))
    numbers = {(r.row_id, r.field_id): r.value for r in index.numbers.collect()}
    assert numbers[(0, "wheel_diameter")] == 4.0 and numbers[(1, "weight")] == pytest.approx(2.20462262)
    assert not [k for k in numbers if k[1] == "thread_size"]


def test_hits_never_overlap(spark):
    q = spark.createDataFrame([(1, "wheel outside diameter and outside diameter, OD 4 in Wheel  Outside Diameter")], "query_id long, text string")
    a = spark.createDataFrame([("Wheel Outside Diameter", "w"), ("Outside Diameter", "o"), ("OD", "o"), ("diameter", "d"), ("O.D.", "o")], "text string, field_id string")
    got = sorted((r.st, r.en, r.field_id) for r in search.alias_hits(q, a).collect())
    assert [g[2] for g in got] == ["w", "o", "o", "w"]
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_alias_hits_ways_agree(spark):
    texts = ["Wheel  diameter 4 in, wheel", "diameterwheel wheel-diameter", "O.D. 3 and od", "", None, "xOD OD_ (OD)", "WHEEL\nDIAMETER of the wheel diameter"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    a = spark.createDataFrame([("Wheel Diameter", "w"), ("wheel", "x"), ("Diameter", "d"), ("OD", "o"), ("O.D.", "o"), ("(OD)", "p"), (" ", "z"), (None, "z")], "text string, field_id string")
    few, many = (sorted(map(tuple, search.alias_hits(q, a, most).collect())) for most in (100, 0))
    assert few == many and {(r[0], r[4]) for r in few} >= {(0, "w"), (0, "x"), (1, "x"), (2, "o"), (5, "p"), (6, "w")}


def test_search_from_end_to_end(spark):
    index = catalog.build_index(rows(spark), catalog.mine(rows(spark)))
    asked = spark.createDataFrame([(1, "a caster with wheel diameter 5 in"), (2, "air motor"), (3, "")], "query_id long, text string")
    got = index.search(asked, search.SearchOptions(k=2)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.kind) for r in got] == [(1, "ranked"), (2, "ranked"), (2, "ranked"), (3, "ranked"), (3, "ranked")]
    assert got[0].row_id == 1 and got[1].row_id == 2 and {"raw_title", "description", "sku"} <= set(got[0].asDict())
    for r in index.vectors.collect():
        assert sum(x * x for x in r.vec) == pytest.approx(1.0) or not any(r.vec)


def test_numeric_last_wins(spark):
    schema = numeric.numeric_schema(spark.createDataFrame([(0, "size", "numeric", "length"), (1, "note", "string", None)], "ord int, id string, type string, unit_family string"))
    keys = numeric.key_fields(spark.createDataFrame([(0, "Size", "size"), (1, "note", "note")], "ord int, text string, field_id string"), schema)
    pairs = spark.createDataFrame([(1, 0, "size", "1 in"), (1, 1, "SIZE", "2 ft"), (1, 2, "size", "big"), (2, 0, "size", "3 psi"), (3, 0, "note", "4")], "row_id long, pos int, key string, value string")
    long = numeric.numeric_long(pairs, keys, schema)
    assert [tuple(r) for r in long.collect()] == [(1, "size", 24.0)]
    assert [tuple(r) for r in numeric.numeric_wide(long, ["size"]).collect()] == [(1, 24.0)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('name,specs\nA,"{""k"": ""1\n2""}"\nB,\n')
    df = sources.read_catalog(spark, str(tmp_path / "c.csv"), required="specs")
    assert [(r.name, r.specs) for r in df.orderBy("row_id").collect()] == [("A", '{"k": "1\n2"}'), ("B", "")]
    assert sources.read_catalog(spark, str(tmp_path / "c.csv"), max_rows=1).count() == 1
    with pytest.raises(ValueError):
        sources.read_catalog(spark, str(tmp_path / "c.csv"), required="nope")
    (tmp_path / "k.json").write_text(json.dumps({"keys": [{"key": "a", "count": 3, "example": "x"}, {"count": 1}, {"key": "b", "count": "no"}]}))
    assert [tuple(r) for r in sources.read_raw_keys(spark, str(tmp_path / "k.json")).collect()] == [(0, "a", 3, "x"), (2, "b", 0, "")]
    keys = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    sinks.write_csv(keys, str(tmp_path / "o.csv"), ["n", "t", "more"])
    assert spark.read.csv(str(tmp_path / "o.csv"), header=True).columns == ["n", "t", "more"]
    sinks.write_envelope(keys, str(tmp_path / "e"), "fields", ["n"])
    assert [x.n for x in spark.read.json(str(tmp_path / "e")).first().fields] == [1, 2]
    sinks.write_alias_map(spark.createDataFrame([("A", "a")], "text string, field_id string"), str(tmp_path / "m"))
    assert [tuple(r) for r in sources.read_aliases(spark, str(tmp_path / "m")).collect()] == [(0, "A", "a")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbad\n\n{"a": 2}\n')
    assert [r.a for r in sources.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").orderBy("row_id").collect()] == [1, None, None, 2]
    assert not sinks.write_lines(keys.where("false"), str(tmp_path / "w"), "t") and sinks.write_lines(keys.where("n = 1"), str(tmp_path / "w"), "t")
    with pytest.raises(FileNotFoundError):
        sources.require_paths(spark, [str(tmp_path / "absent")])


def test_streaming_counts(spark, tmp_path):
    spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2, "b": 3}')], "i long, c string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, c string").parquet(str(tmp_path / "in"))
    stream_key_counts(stream, "c", "i", "key_counts", str(tmp_path / "cp")).awaitTermination(60)
    assert {r.key: r["count"] for r in spark.table("key_counts").collect()} == {"a": 2, "b": 1}


def test_files_and_command_line(spark, tmp_path, capsys):
    from gristmill.__main__ import main

    rows(spark).drop("row_id").coalesce(1).write.csv(str(tmp_path / "c"), header=True, quote='"', escape='"')
    at, out = str(tmp_path / "c"), str(tmp_path / "out")
    common = ["--catalog", at, "--min-support", "1"]
    assert main(["harvest", "--catalog", at, "--out", out], spark) == 0
    assert main(["mine", *common, "--out", f"{out}/dry", "--dry-run"], spark) == 0 and not (tmp_path / "out/dry/alias_map.enriched.json").exists()
    assert main(["mine", *common, "--out", f"{out}/mined"], spark) == 0
    report = spark.read.csv(f"{out}/mined/spec_key_report.csv", header=True)
    assert report.columns == files.REPORT and [int(r["count"]) for r in report.collect()] == sorted((int(r["count"]) for r in report.collect()), reverse=True)
    assert spark.read.csv(f"{out}/mined/raw_keys.csv", header=True).first().key == "Wheel Diameter"
    assert [r.id for r in sources.read_fields(spark, f"{out}/mined/fields.semantic.json").orderBy("ord").collect()] == [r.id for r in report.collect()]
    for name in ("accepted", "blocked", "orphans"):
        assert (tmp_path / f"out/mined/audit/{name}.jsonl").exists()
    assert main(["index", *common, "--out", f"{out}/index", "--dims", "32"], spark) == 0
    index = files.read_index(spark, f"{out}/index", embed.hash_embedder(32))
    again = catalog.build_index(sources.read_catalog(spark, at), catalog.mine(sources.read_catalog(spark, at), min_support=1), embed.hash_embedder(32))
    for part in ("meta", "vectors", "numbers", "aliases", "schema"):
        a, b = getattr(index, part).drop("ord"), getattr(again, part).drop("ord")
        assert sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(a.columns)).collect())), part
    capsys.readouterr()
    assert main(["search", "--index", f"{out}/index", "--dims", "32", "--query", "caster wheel diameter 4 in", "--k", "1"], spark) == 0
    assert "Swivel Caster" in capsys.readouterr().out
