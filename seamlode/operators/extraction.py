"""Facts read off sentences and tables by rules, and their way into batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamlode.functions import domain, numeric
from seamlode.functions import text as T

# A number with a unit, hints of quantities, directions and words of materials, as they stand in sentences.
_MEASURED = r"(\d[\d\s.,–\-±]*)\s*(%|°C|К\b|МПа|ГПа|мг/л|мг/дм3|мг/дм³|г/л|г/т|кВт·ч/т|м3/ч|м³/ч|м/ч|мин\b|HV\d*|HRC|HB\b|В\b|А/м2|А/м²|мкм)"
HINTS = [
    ("извлечени", "степень извлечения"), ("recovery", "recovery"), ("содержани", "содержание элемента"), ("твёрдост", "твёрдость"), ("твердост", "твёрдость"), ("прочност", "предел прочности"),
    ("текучест", "предел текучести"), ("сухой остаток", "сухой остаток"), ("минерализац", "минерализация"), ("скорост", "скорость потока"), ("потенциал", "потенциал"),
    ("плотность тока", "плотность тока"), ("температур", "температура"), ("расход", "расход"), ("выход по току", "выход по току"), ("энерго", "энергоёмкость"),
]
DIRECTIONS = [("увелич|повыша|растёт|возраста|улучша", "increases"), ("сниж|уменьша|падает|ухудша", "decreases"), ("не (?:изменя|влия)|стабильн", "no_change")]
_MATERIAL = r"(?iu)(?<![\p{L}])(?:концентрат|штейн|файнштейн|шлак|раствор|электролит|руд[аыу]|анод|катод|кек|осадок|осадк|пульп|сульфит натрия|кислот[аы]|вод[аы]|уголь|графит)\p{L}*"
# Headers of tables -> property, in the order in which they are tried.
HEADERS = [
    ("yield|proof", "yield strength"), ("tensile|uts", "tensile strength"), ("elongation", "elongation"), ("hardness|\\bhv\\b|\\bhrc\\b", "hardness"), ("grain", "grain size"), ("density", "density"),
    ("temperature|temp\\b", "temperature"), ("holding.time|time\\b", "holding time"), ("pressure", "pressure"), ("atmosphere|atmos", "atmosphere"),
]
_REGIME = ("temperature", "temp", "time", "pressure", "atmosphere", "holding", "duration")


def sentences(text: Column) -> Column:
    """Sentences that a capital letter begins."""
    return F.filter(F.split(text, r"(?<=[.!?;])\s+(?=[А-ЯЁA-Z])"), lambda s: F.trim(s) != "")


def hint(sentence: Column, table: list[tuple[str, str]] = HINTS) -> Column:
    low, out = F.lower(sentence), F.lit(None).cast("string")
    for word, name in reversed(table):
        out = F.when(F.contains(low, F.lit(word)), name).otherwise(out)
    return out


def direction(sentence: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(DIRECTIONS):
        out = F.when(F.lower(sentence).rlike(pattern), name).otherwise(out)
    return out


def materials(sentence: Column) -> Column:
    return F.array_distinct(F.transform(T.found_all(sentence, _MATERIAL), F.lower))


def facts(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, sentence, property, value, unit, direction, material) of each sentence with a hint of a quantity and a number with a unit, or a direction."""
    rows = chunks.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col))).alias("at", "sentence"))
    pattern = "(?iu)" + _MEASURED
    rows = rows.select(
        "doc_id", "at", F.left(F.trim("sentence"), F.lit(400)).alias("sentence"), hint(F.col("sentence")).alias("property"), F.nullif(F.trim(F.regexp_extract("sentence", pattern, 1)), F.lit("")).alias("value"),
        F.nullif(F.regexp_extract("sentence", pattern, 2), F.lit("")).alias("unit"), direction(F.col("sentence")).alias("direction"), F.get(materials(F.col("sentence")), F.lit(0)).alias("material"),
    )
    return rows.where("property is not null and (value is not null or direction is not null)")


def measurements(found: DataFrame) -> DataFrame:
    """Measured facts with their kind, subject, and value in the canonical unit."""
    rows = found.where("value is not null").withColumn("q", domain.quantity_of(F.col("property"), F.coalesce("unit", F.lit(""))))
    rows = rows.withColumn("v", numeric.canonical_range(numeric.parse_value(F.col("value")), F.col("unit")))
    return rows.where("q.kind is not null").select("doc_id", "at", F.col("q.kind").alias("kind"), F.col("q.subject").alias("subject"), "v.low", "v.nominal", "v.high", F.col("v.unit").alias("unit"), F.col("v.scale").alias("scale"), "material", F.col("sentence").alias("snippet"))


def conditions(chunks: DataFrame, known: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, treatment, material): temperatures, times and atmospheres of each sentence that names a known material, with the first it names."""
    low = F.lower("sentence")
    first = F.array_sort(F.filter(F.transform(F.array(*map(F.lit, known)), lambda m: F.struct(F.position(F.lower(m), low).alias("at"), m.alias("name"))), lambda x: x["at"] > 0))
    rows = chunks.select(F.col(id_col).alias("doc_id"), F.explode(sentences(F.col(text_col))).alias("sentence")).withColumn("material", F.get(first, F.lit(0))["name"]).where("material is not null")
    said = lambda x: F.concat(F.coalesce(F.concat(x["low"].cast("string"), F.when(x["low"] != x["high"], F.concat(F.lit("–"), x["high"].cast("string"))).otherwise("")), x["high"].cast("string")), x["unit"])
    air = F.transform(T.found_all(low, r"\b(vacuum|argon|nitrogen|air|hydrogen|oxygen|вакуум|аргон|азот|воздух)", 1), lambda x: x)
    every = F.concat(F.transform(domain.temperatures_of(F.col("sentence")), said), F.transform(domain.durations_of(F.col("sentence")), said), air)
    out = rows.select("doc_id", "material", F.explode(every).alias("said"))
    return out.select("doc_id", domain.treatment_of(F.col("said")).alias("treatment"), "material").where(F.length("treatment") >= 2).distinct()


def header_property(header: str) -> str | None:
    return next((name for pattern, name in HEADERS if re.search(pattern, header.lower())), None)


def table_relations(table: list[list[str | None]]) -> list[tuple[str, str, str, str]]:
    """(source, relation, target, type of target) of a table: rows of specimens with columns of properties, or rows of properties with columns of treatments."""
    rows = [[(c or "").replace("\n", " ").strip() for c in r] for r in table]
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    if len(rows) < 2:
        return []
    number = lambda c: bool(re.fullmatch(r"\s*[~≈]?[-–]?\d[\d.,\s±×eE+\-]*\s*", c))

    def value(cell: str, header: str) -> str:
        unit = re.search(r"\(([^)]+)\)", header)
        return re.sub(r"\s*±\s*[\d.]+", "", cell).strip() + (f" {unit[1].strip()}" if unit else "")

    out: dict[tuple[str, str, str, str], None] = {}
    named = [(j, p) for j, h in enumerate(rows[0]) if j and (p := header_property(h))]
    for r in rows[1:]:
        if len(r[0]) >= 2 and not number(r[0]):
            for j, p in named:
                if number(r[j]):
                    out[r[0], "affects", p, "PROPERTY"] = None
                    out[r[0], "affects", value(r[j], rows[0][j]), "VALUE"] = None
    if out:
        return list(out)
    for r in rows[1:]:
        regime, p = any(w in r[0].lower() for w in _REGIME), header_property(r[0])
        for j, head in enumerate(rows[0]):
            if j and head and r[j] and r[0]:
                if regime and (number(r[j]) or not number(r[j])):
                    out[domain.treatment(value(r[j], r[0]) if number(r[j]) else r[j]), "uses_material", head, "MATERIAL"] = None
                elif p and number(r[j]):
                    out[head, "affects", p, "PROPERTY"] = None
                    out[head, "affects", value(r[j], r[0]), "VALUE"] = None
    return list(out)


def relations_of_tables(tables: DataFrame) -> DataFrame:
    """(doc_id, source, relation, target, target_type) of tables(doc_id, cells array<array<string>>)."""

    @F.pandas_udf("array<struct<source:string,relation:string,target:string,target_type:string>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda t: [dict(zip(("source", "relation", "target", "target_type"), x)) for x in table_relations([list(r) for r in t])])

    return tables.select("doc_id", F.explode(run("cells")).alias("r")).select("doc_id", "r.*").distinct()


# Types of source and target -> relation.
RELATIONS = {
    ("PROCESS", "MATERIAL"): "uses_material", ("PROCESS", "EQUIPMENT"): "operates_at_condition", ("MATERIAL", "PROPERTY"): "affects", ("PROCESS", "PROPERTY"): "produces_output",
    ("EXPERT", "PUBLICATION"): "described_in", ("FACILITY", "EXPERT"): "performed_by", ("EXPERIMENT", "PUBLICATION"): "described_in",
}


def entities(chunks: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, text, label, start): entries of gazetteer(term, label) that stand as whole words in a sentence.

    Sentences and terms meet by the term's first word, and only there the whole term is looked for.
    """
    rows = chunks.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col))).alias("at", "sentence"))
    words = rows.select("doc_id", "at", "sentence", F.explode(F.array_distinct(T.terms(F.col("sentence")))).alias("word"))
    known = gazetteer.select("term", "label", F.get(T.terms(F.col("term")), F.lit(0)).alias("word")).where("word is not null")
    met = words.join(known, "word")
    start = F.position(F.lower("term"), F.lower("sentence"))
    before, after = F.substring("sentence", start - 1, F.lit(1)), F.substring("sentence", start + F.length("term"), F.lit(1))
    whole = (start > 0) & ~((start > 1) & before.rlike(r"[\p{L}\p{N}]")) & ~after.rlike(r"[\p{L}\p{N}]")
    return met.where(whole).select("doc_id", "at", F.col("term").alias("text"), "label", start.alias("start")).distinct()


def relations(found: DataFrame) -> DataFrame:
    """(doc_id, source, relation, target): entities of one sentence whose types relate, in the order of the sentence, one of each triple a document."""
    a = found.select("doc_id", "at", F.col("text").alias("source"), F.col("label").alias("x"), F.col("start").alias("s"))
    b = found.select("doc_id", "at", F.col("text").alias("target"), F.col("label").alias("y"), F.col("start").alias("t"))
    named = numeric.lookup({f"{p}>{q}": r for (p, q), r in RELATIONS.items()}, F.concat("x", F.lit(">"), "y"))
    pairs = a.join(b, ["doc_id", "at"]).where("source <> target").withColumn("relation", named).where("relation is not null")
    return pairs.select("doc_id", "source", "relation", "target").distinct()


def relocated(quotes: DataFrame, blocks: DataFrame, least: float = 85.0) -> DataFrame:
    """quotes(quote_id, doc_id, quote) with locator and factor: 1.0 for the first block that holds the quote, 0.9 for the likest of at least ``least`` per cent, else 0.5 and the first block. blocks(doc_id, place, locator, text)."""
    from seamlode.operators.retrieval import best_per_key, least_edits

    flat = quotes.withColumn("flat", F.trim(F.regexp_replace("quote", r"\s+", " ")))

    @F.pandas_udf("double")
    def alike(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series([100.0 * (1 - least_edits(*sorted((x or "", y or ""), key=len)) / max(1, min(len(x or ""), len(y or "")))) for x, y in zip(q, t)], dtype=float)

    rows = flat.join(blocks, "doc_id", "left").withColumn("held", F.contains("text", "flat") & (F.col("flat") != ""))
    has = rows.groupBy("quote_id").agg(F.max("held").alias("any"))
    scored = rows.join(has, "quote_id").withColumn("score", F.when(F.col("any"), F.when(F.col("held"), 100.0).otherwise(0.0)).otherwise(alike("flat", "text")))
    best = best_per_key(scored, ["quote_id"], [F.desc("score"), F.asc("place")])
    first = blocks.groupBy("doc_id").agg(F.min_by("locator", "place").alias("first"))
    out = best.join(first, "doc_id", "left")
    good = F.col("any") | (F.col("score") >= least)
    return out.select("quote_id", "doc_id", F.when(good, F.col("locator")).otherwise(F.coalesce("first", F.lit("p1"))).alias("locator"), F.when(F.col("any"), 1.0).when(F.col("score") >= least, 0.9).otherwise(0.5).alias("factor"))


def lineage_edges(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, product, source, process) of claims(quote_id, doc_id, product, source, process, quote): one of each pair, quoted in its document."""
    good = claims.where("trim(coalesce(quote, '')) <> '' and trim(coalesce(product, '')) <> '' and trim(coalesce(source, '')) <> '' and product <> source")
    placed = good.join(relocated(good.select("quote_id", "doc_id", "quote"), blocks).where("factor >= 0.85").select("quote_id"), "quote_id", "left_semi")
    once = placed.groupBy("doc_id", "product", "source").agg(F.min_by("process", "quote_id").alias("process"))
    return once.withColumn("process", domain.process_of(F.col("process")))


def batches(found: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, experiments, lineage) of measured facts(doc_id, chunk, process, materials array<struct<name, role>>, measurements) and docs(doc_id, title, text).

    Documents get language, country and year; an experiment is a chunk; lineage links each output of an experiment to each of its inputs.
    """
    head = docs.select("doc_id", F.left("title", F.lit(200)).alias("title"), T.language(F.col("text")).alias("lang"), T.first_year(F.col("text")).alias("year"))
    head = head.withColumn("country", F.when(F.col("lang") == "ru", "RU").otherwise("XX"))
    made = found.select(F.concat_ws(":", "doc_id", F.col("chunk").cast("string")).alias("experiment_id"), "doc_id", domain.process_of(F.col("process")).alias("process"), "materials", "measurements")
    of = lambda role: F.filter("materials", lambda m: m["role"] == role)
    links = made.select("experiment_id", "process", F.explode(of("output")).alias("o"), of("input").alias("inputs")).select("experiment_id", "process", F.col("o.name").alias("product"), F.explode("inputs").alias("i"))
    return head, made, links.select("experiment_id", "product", F.col("i.name").alias("source"), "process").where("product <> source")
