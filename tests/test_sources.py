"""File sources, sinks, queues, search over small corpora, and extraction, on files made here."""

from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from seamlode import tools
from seamlode.operators import extraction, quality, search
from seamlode.sources import files, sinks, tables
from seamlode.streaming import queue


def test_glossaries(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffTerm,LABEL,lang\nмедь,material,\nX1,odd,en\n", "utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"PROCESS": ["leaching", " "], "UNKNOWN": ["медь"]}), "utf-8")
    (tmp_path / "c.jsonl").write_text('{"term":"Leaching","label":null}\n\n{"term":"x1","label":"EQUIPMENT","lang":"en"}\n', "utf-8")
    got = files.seed_terms(spark, [str(tmp_path / f) for f in ("a.csv", "b.json", "c.jsonl", "d.doc")]).collect()
    assert sorted(tuple(r) for r in got) == [("leaching", "PROCESS", "en"), ("x1", "EQUIPMENT", "en"), ("медь", "MATERIAL", "ru")]
    (tmp_path / "s.yaml").write_text("desalination_water:\n  - обессоливание\n  - опреснение\nonly:\n  - latin\nflow: [расход, flow rate]\n", "utf-8")
    assert sorted(r["forms"] for r in files.synonym_groups(spark, str(tmp_path / "s.yaml")).collect()) == [["desalination water", "обессоливание", "опреснение"], ["flow", "flow rate", "расход"]]


def test_batches_and_facts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.json", '{"doc_id": "d", "n": 1}'), ("b.json", '{"doc_id": '), ("_c.json", '{"doc_id": "z"}')):
        (tmp_path / "in" / name).write_text(text)
    good, bad = files.json_batches(spark, str(tmp_path / "in"), "doc_id string, n int")
    assert [(r["doc_id"], r["n"]) for r in good.collect()] == [("d", 1)] and [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["b.json"]
    (tmp_path / "f" / "deep").mkdir(parents=True)
    (tmp_path / "f" / "deep" / "doc7.json").write_text('{"entities": [{"text": "Cu", "label": "MATERIAL"}]}')
    facts, _ = files.json_facts(spark, str(tmp_path / "f"))
    assert [(r["doc_id"], r["entities"][0]["text"]) for r in facts.collect()] == [("doc7", "Cu")]


def test_documents(spark, tmp_path):
    xml = "<w:document><w:p><w:t>First &amp; only</w:t></w:p><w:p><w:t>x</w:t></w:p><w:p><w:t>Third</w:t></w:p></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    blocks, bad = files.office_blocks(spark, str(tmp_path))
    assert sorted((r["locator"], r["text"]) for r in blocks.collect()) == [("para:0", "First & only"), ("para:2", "Third")] and bad.count() == 1
    (tmp_path / "m.md").write_bytes("---\ntype: Parsed Document\ntitle: \"T: 1\"\nraw:\n  path: a.pdf\n  size: 5\n---\n# H\n\nbody \xff".encode("latin-1"))
    (tmp_path / "n.md").write_text("no header\n\n```\n\nmore of it")
    docs, rejects = files.okf(spark, str(tmp_path))
    row = docs.first()
    assert (row["type"], row["title"], json.loads(row["fields"])["raw"]) == ("Parsed Document", "T: 1", {"path": "a.pdf", "size": 5}) and row["body"].startswith("# H")
    assert [r["error"] for r in rejects.collect()] == ["NO_FRONTMATTER"]
    assert {r["text"] for r in files.markdown_blocks(spark, str(tmp_path)).where("path like '%n.md'").collect()} == {"no header", "more of it"}
    assert files.markdown_corpus(spark, str(tmp_path)).count() == 2
    text = spark.range(1).select(files.okf_text({"type": F.lit("X"), "title": F.lit('a "b": c'), "n": F.lit(None).cast("string")}, F.lit("body")).alias("t")).first()["t"]
    assert text.startswith("---\ntype: ") and files.split_front_matter(text)[0]["type"] == "X" and files.split_front_matter("---\na: 1\n---\n")[2] == "MISSING_TYPE"
    np.save(tmp_path / "e.npy", np.eye(2, dtype=np.float32))
    (tmp_path / "e.jsonl").write_text('{"text":"a"}\n{"text":"b"}\n')
    got = files.aligned_matrix(spark, str(tmp_path / "e.jsonl"), str(tmp_path / "e.npy")).collect()
    assert {r["text"]: r["embedding"] for r in got} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    paths = spark.createDataFrame([("RAW_DATA/x/a.pdf",), ("RAW_DATA/b.PDF",), ("UPLOAD_DATA/c.pdf",), ("RAW_DATA/.hid/d.pdf",)], "path string")
    done = spark.createDataFrame([("00_docling_raw/RAW_DATA/b.PDF.md",)], "path string")
    assert [r["path"] for r in files.raw_listing(paths, done, "RAW_DATA").collect()] == ["RAW_DATA/.hid/d.pdf", "RAW_DATA/x/a.pdf"]
    assert [(r["path"], r["type"]) for r in files.tree(paths, "RAW_DATA").collect()] == [("b.PDF", "file"), ("x", "dir"), ("x/a.pdf", "file")]
    assert files.table_sentences([["steel", "HV"], ["A", "100"], ["B", None]]) == ["steel A, HV 100.", "steel B."]


def test_sinks(spark, tmp_path):
    t = sinks.Table(spark, str(tmp_path), "docs", "path string, body string", ["path"])
    rows = spark.createDataFrame([("a", "1"), ("a", "0"), ("b", "2")], "path string, body string")
    assert t.insert_new(rows) == {"read": 3, "added": 2} and t.insert_new(rows) == {"read": 3, "added": 0}
    t.put(spark.createDataFrame([("a", "9")], "path string, body string"))
    assert sorted(map(tuple, t.read().collect())) == [("a", "9"), ("b", "2")] and t.get(["a", "", None]).count() == 1
    v = sinks.Table(spark, str(tmp_path), "results", "id string, v int, superseded_by string", ["id"])
    v.put(spark.createDataFrame([("r1", 1, None)], "id string, v int, superseded_by string"))
    v.supersede(spark.createDataFrame([("r2", 2, None, "r1")], "id string, v int, superseded_by string, old_id string"), "id")
    assert sorted(map(tuple, v.read().collect())) == [("r1", 1, "r2"), ("r2", 2, None)]
    store = sinks.Store(spark, str(tmp_path))
    store.put_text("x.txt", "one")
    assert store.get("x.txt") == b"one" and store.delete("x.txt") and store.get("x.txt") is None
    spark.createDataFrame([(1, "a")], "n int, s string").createOrReplaceTempView("some_rows")
    assert tables.scalar(spark, "SELECT s FROM some_rows WHERE n = :n", {"n": 1}) == "a" and tables.scalar(spark, "SELECT s FROM some_rows WHERE n = :n", {"n": 2}) is None


def test_two_stages(spark, tmp_path):
    at = datetime(2024, 1, 1)
    first, second = str(tmp_path / "q0"), str(tmp_path / "q1")
    queue.reindex(spark.createDataFrame([("a",), ("b",), ("bad",)], "path string"), first, "raw", at)
    table = lambda name, schema: sinks.Table(spark, str(tmp_path), name, schema, ["path"])
    raw, clean, failed = table("raw", "path string, body string"), table("clean", "path string, body string"), table("failed", "path string, stage string, error string")
    work = lambda jobs: jobs.select("path", F.when(F.col("path") != "bad", F.upper("path")).alias("body"), F.when(F.col("path") == "bad", "broken").alias("error"))
    for _ in range(2):  # the second run finds nothing new
        queue.run_stage(spark, first, str(tmp_path / "c0"), raw, failed, work, second, "clean")
    queue.run_stage(spark, second, str(tmp_path / "c1"), clean, failed, work)
    assert sorted(map(tuple, raw.read().collect())) == [("a", "A"), ("b", "B")] == sorted(map(tuple, clean.read().collect()))
    none = spark.createDataFrame([], "path string, stage string")
    status = queue.statuses(spark.createDataFrame([("a",), ("bad",), ("new",)], "path string"), {"raw": raw.read()}, failed.read(), none, none.select("path"))
    assert sorted(map(tuple, status.collect())) == [("a", "raw", "done"), ("bad", "raw", "failed"), ("new", "raw", "pending")]
    asked = spark.createDataFrame([("k", i, datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate((0, 5, 9, 10, 12))], "key string, id long, at timestamp")
    assert [r["allowed"] for r in queue.rate_limited(asked, 2, 10).orderBy("id").collect()] == [True, True, False, True, True]
    assert [queue.step("downloading", "done", None), queue.step(None, "created", None), queue.step("failed", "done", None)] == ["done", "skipped", "failed"]


def test_search(spark):
    texts = ["Leaching of nickel at 80 °C gives recovery of 95 %.", "Roasting of ore in air.", "Nickel matte is roasted.", "Water is clean."]
    rows = [(str(i), "claim", f"d{i}.pdf", "finding", t, t) for i, t in enumerate(texts)]
    p = spark.createDataFrame(rows, "id string, source string, doc_name string, kind string, text string, snippet string")
    words = search.Synonyms([["leaching", "выщелачивание"]], {"ni": "nickel metal"})
    found = search.search(p, "выщелачивание nickel", 3, words)
    assert [r["id"] for r in found.passages.collect()][0] == "0" and "leaching" in found.expanded and found.note is None
    assert search.search(p, "qwertyuiop zxcvbnmm nickel", 3).note and search.search(p, "a b", 3).passages.count() == 0
    v = p.withColumn("embedding", F.when(F.col("id") == "3", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    assert [r["id"] for r in search.hybrid(v, ["nickel"], 2, [1.0, 0.0]).collect()] == ["0", "2"]
    assert [r["doc_id"] for r in tools.retrieve(p.withColumnRenamed("id", "doc_id"), "roastng of ore", "fuzzy", 1).collect()] == ["1"]
    m = spark.createDataFrame([("concentration", None, 50.0, None, "мг/л", "s one", "d1"), ("concentration", 1.0, None, 3.0, "г/л", "s two", "d2"), ("concentration", None, 5.0, None, "t", "s", "d3")], "kind string, low double, nominal double, high double, unit string, snippet string, doc_name string")
    assert [(r["doc_name"], round(r["canonical"], 3)) for r in search.measurements(m, "concentration", 0.01, 2.5).collect()] == [("d1", 0.05), ("d2", 2.0)]
    q = spark.createDataFrame([("Есть ли противоречия?", None), ("Извлечение не менее 90,5", "recovery_degree"), ("какие методы", "recovery_degree")], "q string, k string")
    assert [tuple(r["i"]) for r in q.select(search.intent(F.col("q"), F.col("k")).alias("i")).collect()] == [("find_contradictions", None, None), ("evidence", ">=", 90.5), ("search_passages", None, None)]
    nodes = spark.createDataFrame([("nickel", "MATERIAL", ["d0", "d2"]), ("leaching", "PROCESS", ["d0"]), ("ore", "MATERIAL", ["d1"])], "text string, type string, sources array<string>")
    edges = spark.createDataFrame([("leaching", "nickel", "uses_material", ["d0"])], "src string, dst string, predicate string, sources array<string>")
    docs = p.select(F.concat(F.lit("d"), "id").alias("doc_id"), "text")
    got = search.graph_retrieve(nodes, edges, docs, "leaching nickel")
    assert got["outcome"] == "strong" and got["sources"].first()["doc_id"] == "d0" and got["edges"].count() == 1
    assert tools.invoke("nothing", {})["error"] == "unknown_tool" and len(tools.manifest()) == 14


def test_extraction(spark):
    chunks = spark.createDataFrame([(1, "Степень извлечения никеля из штейна составила 95,5 %. Прочность растёт при обжиге. The sample was annealed at 600 °C for 2 h in argon.")], "doc_id int, text string")
    found = extraction.facts(chunks)
    assert [(r["property"], r["value"], r["unit"], r["direction"], r["material"]) for r in found.orderBy("at").collect()] == [("степень извлечения", "95,5", "%", None, "штейна"), ("предел прочности", None, None, "increases", None)]
    assert [(r["kind"], r["nominal"], r["unit"]) for r in extraction.measurements(found).collect()] == [("recovery_degree", 95.5, "%")]
    assert {r["treatment"] for r in extraction.conditions(chunks, ["sample"]).collect()} == {"600.0°C", "2.0h", "argon"}
    assert extraction.table_relations([["Specimen", "Yield strength (MPa)"], ["316L", "557 ± 7"]]) == [("316L", "affects", "yield strength", "PROPERTY"), ("316L", "affects", "557 MPa", "VALUE")]
    gaz = spark.createDataFrame([("annealed", "PROCESS"), ("sample", "MATERIAL"), ("arg", "MATERIAL")], "term string, label string")
    ents = extraction.entities(chunks, gaz)
    assert {(r["text"], r["label"]) for r in ents.collect()} == {("annealed", "PROCESS"), ("sample", "MATERIAL")}
    assert [tuple(r)[1:] for r in extraction.relations(ents).collect()] == [("annealed", "uses_material", "sample")]
    quotes = spark.createDataFrame([(1, 1, "annealed  at 600"), (2, 1, "Степень извлечения никела из штейна"), (3, 1, "nothing of the kind here")], "quote_id int, doc_id int, quote string")
    blocks = spark.createDataFrame([(1, 0, "p0", "Степень извлечения никеля из штейна составила"), (1, 1, "p1", "was annealed at 600 °C")], "doc_id int, place int, locator string, text string")
    assert sorted((r["quote_id"], r["locator"], r["factor"]) for r in extraction.relocated(quotes, blocks).collect()) == [(1, "p1", 1.0), (2, "p0", 0.9), (3, "p0", 0.5)]


def test_quality(spark):
    a = spark.createDataFrame([("Извлечение 95,5 % [1] источник: X", [("claim 10", ["e1"])])], "summary string, claims array<struct<text:string,experiment_ids:array<string>>>")
    flat = quality.flattened(a)
    cols = {c: F.col(c) for c in ("text", "n_citations", "n_experiment_ids", "n_numeric", "has_patent")}
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    expected = F.array(F.struct(F.lit(95.0).alias("value"), F.lit("=").alias("op"), F.lit(None).cast("double").alias("value2"), F.lit(0.0).alias("tol")), F.struct(F.lit(50.0).alias("value"), F.lit("range").alias("op"), F.lit(60.0).alias("value2"), F.lit(0.0).alias("tol")))
    row = flat.select(
        quality.keyword_score(F.col("text"), words("извлечения"), words("claim", "zz")).alias("k"), quality.numeric_score(F.col("text"), expected).alias("n"),
        quality.provenance_score(cols, words(), F.lit(False), F.lit(2), F.lit(4)).alias("p"), quality.mode_score(F.lit("Fast"), words("search_x"), F.lit("fast"), words("search", "y")).alias("m"),
        quality.honesty_score(F.lit("Нет данных"), words("z")).alias("h"), quality.numbers(F.col("text")).alias("x"),
    ).first()
    assert (row["k"], row["n"], row["p"], row["m"], row["h"]) == (0.75, 0.5, 0.5, 1.0, 1.0) and row["x"] == [95.5, 10.0]
