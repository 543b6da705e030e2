"""Text functions, graph upkeep and streaming windows on small literals."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from seamlode.functions import domain, numeric, pages, text
from seamlode.operators import evidence, graph, mining, retrieval
from seamlode.plans import registry
from seamlode.streaming import windows


def test_uuid5(spark):
    row = spark.range(1).select(text.uuid5(uuid.NAMESPACE_DNS.hex, F.lit("doc-1")).alias("u")).first()
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc-1"))


def test_values_anywhere_in_a_text(spark):
    cases = {
        "about 300±5": (None, 300.0, None, 5.0), "T 20": (None, 20.0, None, None), "10−20": (10.0, None, 20.0, None), "10…20": (10.0, None, 20.0, None), "97–95": (95.0, None, 97.0, None),
        "не менее 7": (7.0, None, None, None), "свыше 8": (8.0, None, None, None), "< = 4": (None, None, 4.0, None), "≤1000": (None, None, 1000.0, None), "0,62": (None, 0.62, None, None), "none": (None,) * 4, "": (None,) * 4,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: tuple(r["v"]) for r in df.select("t", numeric.parse_value(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_units(spark):
    cases = [(20.0, "°C", 293.15, "K", "none"), (2.0, "ГПа", 2000.0, "MPa", "none"), (5.0, " мин ", 300.0, "s", "none"), (7.0, "HV30", 7.0, "HV30", "HV30"), (7.0, "hrc", 7.0, "hrc", "HRC"), (3.0, "null", 3.0, "", "none"), (3.0, "furlong", 3.0, "furlong", "none"), (None, "°C", None, "°C", "none"), (1.0, None, 1.0, "", "none")]
    df = spark.createDataFrame([(i, v, u) for i, (v, u, *_) in enumerate(cases)], "i int, v double, u string")
    got = {r["i"]: tuple(r["c"]) for r in df.select("i", numeric.canonical(F.col("v"), F.col("u")).alias("c")).collect()}
    assert got == {i: tuple(c[2:]) for i, c in enumerate(cases)}
    row = spark.range(1).select(numeric.measured(F.lit(50.0), F.lit("мг/л"), "concentration").alias("a"), numeric.measured(F.lit(50.0), F.lit("t"), "concentration").alias("b"), numeric.any_in_range(F.array(F.lit(10.1)), F.lit(5.0), F.lit(10.0)).alias("c"), numeric.latency_score(F.lit(8.0), 5.0).alias("d"), numeric.shown(F.struct(F.lit(95.0).alias("low"), F.lit(None).cast("double").alias("nominal"), F.lit(97.5).alias("high"))).alias("e")).first()
    assert tuple(row) == (0.05, None, True, 0.5, "95–97.5")


def test_gate_and_agreement(spark):
    schema = "id int, material string, document int, experiment int, value double, kind string, scale string, basis string, unit string, sample_state string, conditions map<string,string>"
    base = ("hardness", None, "wt", "MPa", None, {"temperature_k": "300", "load": "5"})
    rows = [(1, "m", 1, 1, 10.0, *base), (2, "m", 2, 2, 11.0, "hardness", "none", "wt", "GPa", "", {"load": "5"}), (3, "m", 3, 3, 12.0, "hardness", "HV", None, "%", "cast", {"temperature_k": "900", "load": "6"}), (4, "n", 1, 4, 10.0, *base), (5, "n", 2, 5, 40.0, *base), (6, "o", 1, 6, 1.0, "k", "none", None, "K", "", None), (7, "o", 2, 7, 1.0, "k", "none", "b", "K", "", None)]
    df = spark.createDataFrame(rows, schema)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 99)], "a int, b int")
    got = {(r["a"], r["b"]): (r["comparable"], r["blocking"]) for r in evidence.gate_pairs(df, pairs).collect()}
    assert got == {(1, 2): (True, []), (1, 3): (False, ["scale", "basis", "unit_dim", "processing_state", "measurement_conditions"]), (1, 99): (False, ["not_found"])}
    flags = {r["material"]: r["flag"] for r in evidence.agreement(df, "material").collect()}
    assert flags == {"m": "incomparable", "n": "contradictory", "o": "incomparable"}  # a null basis is one more basis
    top = {r["material"]: (r["n"], r["median"], r["other_groups"]) for r in evidence.profile(df, "material").collect()}
    assert top["m"] == (2, 11.0, 1) and top["n"] == (2, 40.0, 0)
    found = evidence.contradictions(df, 0.3).select("a_id", "b_id").collect()
    assert [tuple(r) for r in found] == [(4, 5)]
    row = spark.range(1).select(evidence.reliability(F.lit("catalog"), F.lit(0.5), F.lit(2021)).alias("a"), evidence.reliability(F.lit("x"), F.lit(None).cast("double"), F.lit(None).cast("int")).alias("b"), evidence.severity(F.lit(0.6), F.lit(0.8), F.lit(0.75)).alias("c")).first()
    assert tuple(row) == (0.8, 0.68, "high")


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(text.name_key(lit("a/b/Report.pdf.md"))) == "report" and one(text.clean_name(lit("x/y.PDF"))) == "y" and one(text.clean_name(lit(None).cast("string"))) == "источник не указан"
    assert tuple(one(text.version_of(lit("q1__v02.pdf")))) == ("q1", 2, ".pdf") and one(text.versioned_name(lit("q"), lit(3), lit(".md"))) == "q__v03.md"
    assert tuple(one(text.raw_path(lit("/RAW_DATA/a/b/q1__v02.pdf")))) == ("RAW_DATA", "a/b", "q1", 2, ".pdf", None) and one(text.raw_path(lit("OTHER/x.pdf")))["error"] == "unknown source"
    assert text.subtree_root("/SHARED/a//b/../c") == ("a/c", ["leading slash removed", "shared prefix removed", "separators collapsed"])
    assert one(text.slug(lit("Copper & Nickel"))) == "copper-nickel"
    assert one(text.transliterated(lit("Щелочь-Х"))) == "shchelochkh" and one(text.edit_ratio(lit("abcd"), lit("abxd"))) == 0.75
    assert one(text.case_stem(lit("электроэкстракцию"))) == one(text.case_stem(lit("электроэкстракция"))) and one(text.number_stem(lit("Шлаки"))) == one(text.number_stem(lit("шлака")))
    assert one(text.content_terms(lit("Какие методы обессоливания воды применяют для TDS"))) == ["обессоливания", "воды"]
    assert one(text.boosted_query(F.array(lit("Cu"), lit("of"), lit("electrowinning"), lit("two words")))) == 'Cu OR electrowinning^2 OR "two words"^2'
    assert one(text.from_positions(F.from_json(lit('{"b":[1],"a":[0,2]}'), "map<string,array<int>>"))) == "a b a" and one(text.sanitised(lit("what? is*  it"))) == "what is it"
    assert one(text.article_body(lit('<p>x</p><div itemprop="articleBody"><p>a &amp; <b>b</b></p><p> </p><p>c</p>'))) == "a & b\nc" and one(text.without_tags(lit("<i>a</i> &lt; b"))) == "a < b"
    assert one(text.without_markdown(lit("# T\n\n**b** [l](u) `c`\n\n|a|b|\n|--|--|\n- x"))).split() == ["T", "b", "l", "a", "b", "x"]
    assert one(text.junk_reason(lit("получения сульфата"))) == "ru_verbal_fragment" and one(text.junk_reason(lit("сульфата никеля высокой"))) == "dangling_modifier" and one(text.junk_reason(lit("Tatum-T"))) == "brand_code"
    assert one(text.junk_reason(lit("Ni"), F.array(lit("seed")))) is None and one(text.junk_reason(lit("ЭР"))) == "bare_short_token" and one(text.declension_key(lit("извлечения"))) == one(text.declension_key(lit("извлечение")))
    assert one(text.verbalised(lit("a"), lit(""), lit("r"), lit("b"))) == "a — r — b" and one(text.first_year(lit("in 1979 and 2014"))) == 2014 and one(text.language(lit("медь and"))) == "ru"
    assert one(text.clip(lit("a " * 50), 10)) == "a a a a a…" and one(text.bigrams(F.array(lit("a"), lit("b"), lit("c")))) == ["a b", "b c"] and one(text.safe_lexemes(lit("zn(ii) oxide"))) == ["oxide"]


def test_pages():
    doc = "Report 2020\nThe first line is\nwrapped here.\nPage 1\f" + "Report 2020\nSecond exam-\nple text.\n2\f" + "Report 2020\n# Head\nmore text\nmore text\n\n\n\n\nend of it\n~~~~~~~~~~~~\n3"
    assert pages.repeated_keys(pages.pages_of(pages.normal_text(doc))) == {"report #"}
    assert pages.cleaned(doc) == "The first line is wrapped here.\n\nSecond example text.\n\n# Head\nmore text more text\n\n\nend of it\n"
    assert pages.joined_lines(["```", "a", "b", "```", "x", "y", "Title", "====="]) == ["```", "a", "b", "```", "x y", "Title", "====="]
    assert pages.without_repeats(["a", " a", "", "", "b"]) == ["a", "", "", "b"] and pages.is_page_number("стр. 5 из 9") and pages.is_stamp("Copyright 2020 X") and not pages.is_noise("| a | b |")
    assert pages.block_chunks(["a" * 5, "b" * 5, "c" * 5], 10, 1) == [[0, 1], [1, 2]] and pages.paragraph_chunks("aa\n\nbb\n\n" + "c" * 7, 5) == ["aa", "bb", "ccccc", "cc"]
    assert [len(c) for c in pages.passages("---\nt: 1\n---\n" + "\n\n".join(["word " * 60] * 3))] == [599, 299]
    cut = pages.window("open\n\n" + "x" * 50 + "\n\nnickel nickel\n\nafter\n\n" + "y" * 50, ["nickel"], 60, frozenset())
    assert cut == "open\n\n[…]\n\nnickel nickel\n\nafter\n\n[…]"


def test_domain_rules():
    q = domain.quantity
    assert q("степень извлечения")[0::2] == ("recovery_degree", "exact") and q("извлечение никеля")[:3] == ("recovery_degree", "Ni", "pattern") and q("Cu_extraction")[:2] == ("recovery_degree", "Cu")
    assert q("содержание драгоценных металлов в шлаке")[:2] == ("element_content", "precious") and q("value")[2] == "junk" and q("внешний вид осадка")[0] == "qualitative_observation"
    assert q("неведомое", "мг/л")[:3] == ("concentration", "неведомое", "unit") and q("неведомое")[2] == "unresolved" and q("коэффициент запаса устойчивости борта")[:2] == ("safety_factor", "борта")
    assert domain.subject("Au, Ag и МПГ") == "Au+Ag+PGM" and domain.process("Выщелачивание кека") == "leaching" and domain.process("уравнение") == "other"
    assert domain.treatment("600 oC") == "600°C" and domain.treatment("Furnace cooled") == "furnace cooling"
    assert domain.temperatures("annealed at 600 °C and between 700 and 800 °C") == [(600.0, 600.0, [600.0], "°C"), (700.0, 800.0, [], "°C")] and domain.temperatures("heated at 5 °C/min") == []
    assert domain.durations("held overnight, then 2-3 h") == [(12.0, 12.0, [12.0], "h"), (2.0, 3.0, [], "h")]


def test_mining(spark):
    assert dict(mining.definitions("We use pressure oxidation (POX) and H2SO4 + O2 = x (SO4). SX (solvent extraction) too. Около (около) нет.")) == {"POX": "pressure oxidation", "SX": "solvent extraction"}
    docs = spark.createDataFrame([(1, "электроэкстракция (ЭЭ) идёт"), (2, "после электроэкстракции (ЭЭ) идёт"), (3, "Mining (Mining) x")], "doc_id int, text string")
    row = mining.abbreviations(mining.defined(docs)).collect()
    assert [(r["acronym"], r["n_docs"]) for r in row] == [("ЭЭ", 2)] and row[0]["expansion_variants"] == ["электроэкстракции", "электроэкстракция"]
    terms = spark.createDataFrame([("раствор", "M", ["a"]), ("раствора", "M", ["a", "b"]), ("медь", "M", ["a"])], "term string, label string, sources array<string>")
    assert {r["term"]: r["dropped_for"] for r in mining.declension_dedup(terms).collect()} == {"раствор": None, "раствора": "раствор", "медь": None}
    names = spark.createDataFrame([(t,) for t in ("leaching", "leachin", "leeching", "никель", "nikel", "другое", "xyz")], "term string")
    got = {(r["a"], r["b"]) for r in mining.lexical_pairs(names).collect()}
    all_ = [r["term"] for r in names.collect()]
    key = {t: k for t, k in names.select("term", text.transliterated(F.col("term"))).collect()}
    want = {(a, b) for a in all_ for b in all_ if a < b and 1 - _distance(key[a], key[b]) / max(len(key[a]), len(key[b])) >= 0.85}
    assert got == want and want
    t = spark.createDataFrame([("a1x", "M"), ("a2x", "M"), ("a3x", "P"), ("b1x", "UNKNOWN"), ("c1x", "M")], "term string, label string")
    near = spark.createDataFrame([("a1x", "a2x", 0.95), ("a2x", "a3x", 0.93), ("a2x", "b1x", 0.85), ("a1x", "b1x", 0.82), ("b1x", "c1x", 0.84)], "a string, b string, weight double")
    must = spark.createDataFrame([], "a string, b string, method string")
    groups = {r["term"]: r["cluster"] for r in mining.clusters(t, near, must).collect()}
    assert groups == {"a1x": "a1x", "a2x": "a1x", "b1x": "a1x", "a3x": "a3x", "c1x": "c1x"}  # labels differ; c1x isn't near all of its cluster


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_least_edits():
    import random

    rng = random.Random(1)
    for _ in range(200):
        p, t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        want = min(_distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert retrieval.least_edits(p, t) == want


def test_paths_and_components(spark):
    edges = spark.createDataFrame([("a", "b", "p", ["s"]), ("b", "c", "p", ["t"]), ("c", "a", "p", ["s"]), ("x", "y", "p", ["s"])], "src string, dst string, predicate string, sources array<string>")
    start = spark.createDataFrame([("a", ["s"])], "node string, sources array<string>")
    assert sorted(tuple(r["nodes"]) for r in graph.paths(edges, start, 2).collect()) == [("a", "b"), ("a", "b", "c"), ("a", "c"), ("a", "c", "b")]
    assert sorted(tuple(r["nodes"]) for r in graph.paths(edges, start, 2, True).collect()) == [("a", "b"), ("a", "c")]
    assert {r["node"]: r["root"] for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.shortest_path(edges, "a", "c") == ["a", "c"] and graph.shortest_path(edges, "a", "y") == []
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, 7)], "k int, v int")
    assert sorted(map(tuple, graph.upsert_new(spark.createDataFrame([(2, 9)], "k int, v int"), rows, ["k"]).collect())) == [(1, 3), (2, 9)]


def test_char_share_of_cyrillic(spark):
    df = spark.createDataFrame([("абв abc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.char_share(F.col("t"), "а-яА-Я")).collect()] == [3 / 7, None, None]


def test_null_material_and_document(spark):
    rows = [(1, None, None, 10.0), (2, None, None, 90.0), (3, None, 7, 50.0), (4, 5, 1, 10.0), (5, 5, 2, 11.0)]
    df = spark.createDataFrame(rows, "experiment int, material int, document int, value double").selectExpr("*", "0 AS kind", "'a' AS scale", "'b' AS basis")
    got = evidence.contradictions(df, 0.3).select("a_experiment", "b_experiment").collect()
    assert sorted(map(tuple, got)) == [(1, 3), (2, 3)]


def test_graph_upkeep(spark):
    edges = spark.createDataFrame([("a", "b", "p"), ("b", "c", "p"), ("A", "c", "p")], "src string, dst string, predicate string")
    variants = spark.createDataFrame([("A", "a"), ("b", "a")], "variant string, canonical string")
    assert sorted(map(tuple, graph.remap(edges, variants).collect())) == [("a", "c", "p")]
    nodes = spark.createDataFrame([("x", "M", ["s2", "s1"]), ("x", "M", ["s1"]), ("x", "N", [])], "text string, type string, sources array<string>")
    assert sorted((r[0], r[1], tuple(r[2])) for r in graph.merge_nodes(nodes).collect()) == [("x", "M", ("s1", "s2")), ("x", "N", ())]
    diamond = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "src string, dst string")
    assert graph.lineage(diamond, spark.createDataFrame([("a",)], "root string")).where("node = 'd'").count() == 2


def test_rrf_weights(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = {r["id"]: r["score"] for r in retrieval.rrf([(a, 1.0), (b, 2.0)], "id").collect()}
    assert got == {"x": 1 / 61, "y": 1 / 62 + 2 / 61}


def test_streaming_windows(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    rows = [(at(1, 5), "view"), (at(1, 50), "view"), (at(2, 1), "click"), (at(9, 0), "view")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(source)
    windows.run_available(windows.tumbling_counts(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted((r["window"]["start"].hour, r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "view", 2), (2, "click", 1)]


def test_grids_keep_every_column(spark, tmp_path):
    facts = spark.range(1500).selectExpr("concat('s', id % 2) AS size", "id AS process")
    assert evidence.grid_gaps(facts, "size", "process").count() == 1500
    part = spark.range(1500).selectExpr("id AS p_partkey", "concat('t', id) AS p_type", "concat('b', id % 2) AS p_brand")
    sf = "/root/testdata/sf0.001"
    for f in os.listdir(sf):
        if f != "part.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    part.selectExpr("*", "1 AS p_size", "'c' AS p_container", "'m' AS p_mfgr", "'n' AS p_name", "1.0D AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    assert registry.coverage_grid(spark, str(tmp_path)).select("family", "grade").distinct().count() == 3000


def test_text_cosine_splits_a_text_once(spark):
    from pyspark.sql import functions as F

    from seamlode.functions.text import terms
    from seamlode.operators import retrieval

    # 3,000 different words: a split of the whole text for each of them takes minutes
    rows = [(1, "mit mit apache x"), (2, " ".join(f"w{i} w{i}" for i in range(3000)) + " MIT"), (3, ""), (4, None), (5, "x y"), (6, " ".join(f"v{i}" for i in range(20000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", retrieval.text_cosine(["mit", "mit", "apache"], terms(F.col("text"))).alias("s")).collect()}
    assert got[1] == 5 / (6**0.5 * 5**0.5) and got[2] == 2 / ((3000 * 4 + 1) ** 0.5 * 5**0.5) and [got[i] for i in (3, 4, 5, 6)] == [0, 0, 0, 0]
    assert [r["doc_id"] for r in retrieval.sparse(df, ["mit", "apache"], 5).collect()] == [1, 2]
    plan = df.select(retrieval.text_cosine(["mit"], terms(F.col("text"))).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
