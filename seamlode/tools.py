"""The tools by name: a function of views and arguments that gives a table, with the arguments that it takes.

views is a mapping from a name (results, facts, edges, claims, labs, passages, documents ...) to a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamlode.operators import evidence, graph, retrieval, search

Views = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Tool:
    name: str
    says: str
    arguments: dict[str, str]
    run: Callable[..., DataFrame]


TOOLS: dict[str, Tool] = {}


def tool(says: str, **arguments: str):
    def add(f):
        TOOLS[f.__name__] = Tool(f.__name__, says, arguments, f)
        return f

    return add


def manifest() -> list[dict]:
    """Name, description and JSON schema of each tool."""
    return [{"name": t.name, "description": t.says, "parameters": {"type": "object", "properties": {k: {"type": v} for k, v in t.arguments.items()}}} for t in TOOLS.values()]


def invoke(name: str, views: Views, **arguments) -> dict:
    """{"ok": rows} or {"error": code, "detail": text}."""
    if name not in TOOLS:
        return {"error": "unknown_tool", "detail": name}
    odd = sorted(set(arguments) - set(TOOLS[name].arguments))
    if odd:
        return {"error": "bad_arguments", "detail": ", ".join(odd)}
    try:
        return {"ok": TOOLS[name].run(views, **arguments)}
    except (KeyError, TypeError, ValueError) as e:
        return {"error": "failed", "detail": f"{type(e).__name__}: {e}"}


def _rows(views: Views, **equal) -> DataFrame:
    return evidence.filtered(evidence.current(views["facts"]), {k: v for k, v in equal.items() if v is not None})


@tool("results for a material or process, with a bound on the value", material="string", process="string", quantity_kind="string", value_op="string", value="number", year_from="integer", country="string")
def evidence_(views: Views, material=None, process=None, quantity_kind=None, value_op=None, value=None, year_from=None, country=None) -> DataFrame:
    return evidence.filtered(_rows(views, material=material, process=process, kind=quantity_kind, country=country), None, value_op, value, year_from)


TOOLS["evidence"] = Tool("evidence", TOOLS.pop("evidence_").says, {"material": "string", "process": "string", "quantity_kind": "string", "value_op": "string", "value": "number", "year_from": "integer", "country": "string"}, evidence_)


@tool("envelope, median and spread of the comparable results of a quantity", quantity_kind="string", material="string", process="string")
def evidence_profile(views: Views, quantity_kind, material=None, process=None) -> DataFrame:
    return evidence.profile(_rows(views, kind=quantity_kind, material=material, process=process).withColumn("all", F.lit("all")), "all")


@tool("materials and quantities without results, one-sided practice, few sources", min_sources="integer")
def find_gaps(views: Views, min_sources=3) -> DataFrame:
    low = views["facts"].groupBy(F.col("process").alias("topic")).agg(F.count_distinct("document").alias("n")).where(F.col("n") < min_sources).select(F.lit("low_coverage").alias("gap"), "topic")
    sides = evidence.practice(views["facts"], "process", "country", "document", "RU").where("exclusive <> 'both'").select(F.concat(F.lit("only "), "exclusive").alias("gap"), F.col("process").alias("topic"))
    empty = evidence.grid_gaps(views["facts"], "material", "kind").select(F.lit("empty_cell").alias("gap"), F.concat_ws(" × ", "material", "kind").alias("topic"))
    return low.unionByName(sides).unionByName(empty)


@tool("comparable results of different documents that differ", rel_delta="number")
def find_contradictions(views: Views, rel_delta=0.3) -> DataFrame:
    return evidence.contradictions(evidence.current(views["facts"]), rel_delta)


@tool("practice of a process at home and abroad", process="string")
def compare_practice(views: Views, process) -> DataFrame:
    return evidence.practice(_rows(views, process=process), "process", "country", "document", "RU")


@tool("results of several processes side by side", processes="array")
def compare_technologies(views: Views, processes) -> DataFrame:
    rows = evidence.current(views["facts"]).where(F.col("process").isin(list(processes)))
    return rows.select(F.col("process").alias("method"), F.col("kind").alias("param"), "value", F.when(F.col("country") == "RU", "domestic").otherwise("foreign").alias("origin"), F.col("document").alias("source_ref"))


@tool("labs by their topics and experiments", topic="string", limit="integer")
def find_experts_by_topic(views: Views, topic, limit=5) -> DataFrame:
    words = [w[:-2] if len(w) > 5 else w for w in topic.lower().split() if len(w) >= 5] or [topic.lower()]
    fits = F.exists("expertise", lambda e: F.greatest(F.lit(False), *(F.contains(F.lower(e), F.lit(w)) for w in words)))
    n = views["facts"].groupBy("lab").agg(F.count_distinct("experiment").alias("n_experiments"))
    return views["labs"].where(fits).join(n, "lab", "left").withColumn("n_experiments", F.coalesce("n_experiments", F.lit(0))).orderBy(F.desc("n_experiments"), "lab").limit(limit)


@tool("nodes about an entity", entity="string", depth="integer")
def get_subgraph(views: Views, entity, depth=1) -> DataFrame:
    start = views["edges"].sparkSession.range(1).select(F.lit(entity).alias("node"))
    return graph.subgraph(views["edges"], start, depth)[0]


@tool("what an entity was made from", entity="string")
def lineage(views: Views, entity) -> DataFrame:
    steps = views["edges"].where("predicate = 'derived_from'").select("src", "dst")
    return graph.lineage(steps, steps.sparkSession.range(1).select(F.lit(entity).alias("root"))).where("depth > 0").orderBy("depth", "node")


@tool("experiments by date", material="string", process="string")
def timeline(views: Views, material=None, process=None) -> DataFrame:
    return _rows(views, material=material, process=process).orderBy(F.asc_nulls_last("year"), "experiment").select("year", "experiment", "process", "document")


@tool("documents by method, country and year, and findings that agree", process="string")
def literature_review(views: Views, process=None) -> DataFrame:
    rows = _rows(views, process=process)
    parts = [evidence.documents_by(rows.withColumn(k, F.col(k).cast("string")).withColumn("document", F.col("document").cast("string")), k, "document").select(F.lit(k).alias("by"), F.col(k).alias("value"), "n_docs", "docs") for k in ("process", "country", "year")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@tool("sizes of the corpus")
def coverage(views: Views) -> DataFrame:
    out = None
    for name, df in views.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@tool("passages for an open question", query="string", limit="integer")
def search_passages(views: Views, query, limit=8) -> DataFrame:
    return search.search(views["passages"], query, limit).passages


@tool("measurements of a quantity in a range", quantity="string", value_from="number", value_to="number", query="string", limit="integer")
def search_measurements(views: Views, quantity, value_from=None, value_to=None, query=None, limit=20) -> DataFrame:
    return search.measurements(views["results"], quantity, value_from, value_to, query, limit)


# -- retrieval by type ----------------------------------------------------------------------


def retrieve(docs: DataFrame, query: str, kind: str = "dense", limit: int = 10, folder: str | None = None, folders: list[str] | None = None, vector: list[float] | None = None) -> DataFrame:
    """(doc_id, score) by one of dense, sparse, fuzzy, rrf and advance over docs(doc_id, text, folder, embedding); a folder must be an allowed one. Filters come before the top."""
    if folders is not None and folder not in folders:
        raise ValueError(f"no such folder: {folder}")
    docs = docs if folder is None else docs.where(F.col("folder") == folder)
    words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split()]

    def dense(k: int) -> DataFrame:
        return search.dense(docs.withColumnRenamed("doc_id", "id"), vector or [], k).withColumnRenamed("id", "doc_id")

    def sparse(k: int) -> DataFrame:
        return retrieval.sparse(docs, words, k)

    if kind == "dense":
        return dense(limit)
    if kind == "sparse":
        return sparse(limit)
    if kind == "fuzzy":
        return retrieval.fuzzy(docs, query, limit)
    if kind == "rrf":
        ranked = [(retrieval.ranked(f(2 * limit), "score", "doc_id"), 1.0) for f in (dense, sparse)]
        return retrieval.top(retrieval.rrf(ranked, "doc_id"), "score", "doc_id", limit)
    if kind == "advance":
        both = retrieval.keep_last([dense(2 * limit), sparse(2 * limit)], "doc_id").join(docs.select("doc_id", "text"), "doc_id")
        return retrieval.reranked(both.withColumnRenamed("doc_id", "id"), words, limit).select(F.col("id").alias("doc_id"), "score")
    raise ValueError(f"no such search: {kind}")
