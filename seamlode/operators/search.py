"""Passage search: index, expansion, gate, anchors, hybrid ranks; measurement search; retrieval over a graph.

passages: id, source, doc_name, kind, text, snippet, has_number, and perhaps embedding.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamlode.functions import numeric, pages
from seamlode.functions import text as T
from seamlode.operators import graph, retrieval

_CONTENT = re.compile("[а-яёa-z0-9]{4,}")


def content_terms(query: str, most: int = 14) -> list[str]:
    """The same of a query as ``text.content_terms`` of a column."""
    low = query.lower()
    words = [w for w in dict.fromkeys(_CONTENT.findall(low)) if not w.startswith(tuple(T.QUESTION_STEMS))]
    return (words or re.findall("[а-яёa-z0-9]{5,}", low))[:most]


@dataclass
class Synonyms:
    """Clusters of forms and expansions of abbreviations, for queries."""

    groups: list[list[str]] = field(default_factory=list)
    short: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.of = {f.lower(): {x.lower() for x in g} for g in self.groups for f in g}
        self.short = {k.lower(): v.lower() for k, v in self.short.items()}

    def known(self, term: str) -> bool:
        return term.strip().lower() in self.of or term.strip().lower() in self.short

    @staticmethod
    def lexemes(form: str) -> set[str]:
        form = form.strip().lower()
        if re.fullmatch("[а-яёa-z0-9]+", form):
            return {form} if len(form) >= 3 else set()
        return set(_CONTENT.findall(form))

    def forms(self, term: str, most: int = 8) -> set[str]:
        """The term and the lexemes of its other forms, the longest; formulas and grades have no others."""
        t = term.strip().lower()
        if not t:
            return set()
        if re.search(r"^[a-zа-яё]*\d|[a-z]\d|\d[a-z]", t):
            return {t}
        more = self.lexemes(self.short.get(t, "")).union(*(self.lexemes(f) for f in self.of.get(t, ()) if f != t)) - {t}
        return {t, *sorted(more, key=lambda x: (-len(x), x))[: most - 1]}

    def expanded(self, terms: list[str], most: int = 24) -> list[str]:
        """The terms, then the forms of each, without repeats."""
        out = list(dict.fromkeys(t.lower() for t in terms if t))
        return list(dict.fromkeys([*out, *(f for t in terms for f in sorted(self.forms(t)))]))[: max(most, len(out))]


def passage_index(claims: DataFrame, measurements: DataFrame, docs: DataFrame, size: int = 700) -> DataFrame:
    """Passages of claims(id, doc_name, kind, text, snippet), measurements(id, doc_name, kind, value, unit, snippet) and raw texts of docs(doc_id, doc_name, text)."""
    a = claims.select(F.concat(F.lit("claim:"), F.col("id").cast("string")).alias("id"), F.lit("claim").alias("source"), "doc_name", "kind", "text", "snippet")
    said = F.trim(F.concat(F.col("kind"), F.lit(" = "), F.col("value"), F.lit(" "), F.coalesce("unit", F.lit(""))))
    b = measurements.select(F.concat(F.lit("measurement:"), F.col("id").cast("string")).alias("id"), F.lit("measurement").alias("source"), "doc_name", F.lit("measurement").alias("kind"), said.alias("text"), "snippet")
    c = docs.select("doc_id", "doc_name", F.posexplode(pages.passage_list(F.col("text"), size)).alias("at", "text"))
    c = c.select(F.concat_ws(":", F.lit("doc"), F.col("doc_id").cast("string"), F.col("at").cast("string")).alias("id"), F.lit("doc_chunk").alias("source"), T.clean_name(F.col("doc_name")).alias("doc_name"), F.lit("chunk").alias("kind"), "text", F.left("text", F.lit(300)).alias("snippet"))
    return a.unionByName(b).unionByName(c).withColumn("has_number", F.concat_ws(" ", "text", "snippet").rlike(r"\d"))


def _blob() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("snippet", F.lit(""))))


def _has(term: str) -> Column:
    """Whether a passage has a term or, of over five letters, the term without its last two."""
    forms = [term, *([term[:-2]] if len(term) > 5 else [])]
    return F.greatest(F.lit(False), *(F.contains(_blob(), F.lit(f)) for f in forms))


def frequencies(passages: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Number of passages, and of those that have each term: one pass."""
    row = passages.agg(F.count("*"), *(F.count(F.when(_has(t), 1)) for t in terms)).first()
    return row[0], dict(zip(terms, row[1:]))


def absent(passages: DataFrame, terms: list[str], synonyms: Synonyms) -> list[str]:
    """Terms of which no form, of the term and its three shortest others, is in the corpus: one pass."""
    forms = {t: [t, *sorted((f for f in synonyms.forms(t) if f != t), key=lambda f: (len(f), f))[:3]] for t in terms}
    row = passages.agg(*(F.coalesce(F.max(F.greatest(F.lit(False), *map(_has, forms[t]))), F.lit(False)) for t in terms)).first()
    return [t for t, there in zip(terms, row) if not there]


def weights(n: int, df: dict[str, int]) -> dict[str, float]:
    return {t: math.log(1 + (n - x + 0.5) / (x + 0.5)) for t, x in df.items()}


def anchors(idf: dict[str, float], least: float = 1.5) -> list[str]:
    """Terms rare enough to choose candidates by, or else the three rarest."""
    order = sorted(idf, key=lambda t: -idf[t])
    return [t for t in order if idf[t] >= least] or order[:3]


def lexical(passages: DataFrame, idf: dict[str, float], most: int = 40) -> DataFrame:
    """(id, score): passages that have an anchor, by the summed weights of the terms that they have; the top ``most``."""
    by = F.greatest(F.lit(False), *map(_has, anchors(idf)))
    score = sum((F.when(_has(t), w).otherwise(0.0) for t, w in sorted(idf.items())), F.lit(0.0))
    return retrieval.top(passages.where(by).select("id", F.round(score, 9).alias("score")), "score", "id", most)


def dense(passages: DataFrame, vector: list[float], most: int = 40) -> DataFrame:
    """(id, score): passages nearest to a vector by cosine, exactly."""
    q = F.array(*(F.lit(float(x)) for x in vector))
    return retrieval.top(passages.where("embedding is not null").select("id", numeric.cosine(F.col("embedding"), q).alias("score")), "score", "id", most)


def hybrid(passages: DataFrame, terms: list[str], limit: int, vector: list[float] | None = None) -> DataFrame:
    """Passages by fused ranks, lexical of weight 1 and dense of 0.5 from rank 0, one of each document and opening."""
    n, df = frequencies(passages, terms)
    channels = [(retrieval.ranked(lexical(passages, weights(n, df)), "score", "id", 0), 1.0)]
    if vector is not None:
        channels.append((retrieval.ranked(dense(passages, vector), "score", "id", 0), 0.5))
    rows = retrieval.rrf(channels, "id").join(passages, "id")
    rows = rows.withColumn("doc", T.clean_name(F.col("doc_name"))).withColumn("snippet", F.left(F.coalesce("snippet", "text"), F.lit(300)))
    once = retrieval.best_per_key(rows, ["doc", "opening"], [F.desc("score"), F.asc("id")]) if "opening" in rows.columns else retrieval.best_per_key(rows.withColumn("opening", F.left("snippet", F.lit(60))), ["doc", "opening"], [F.desc("score"), F.asc("id")])
    kind = F.when(F.col("source") == "measurement", "measurement").otherwise(F.coalesce("kind", F.lit("finding")))
    return once.orderBy(F.desc("score"), "id").limit(limit).select("id", kind.alias("kind"), "text", "snippet", "doc", F.round("score", 4).alias("rank"))


def boosted(passages: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """The lexical way: weights of terms, 1.6 times for a number and 1.3 times for a measurement, one of each document and opening."""
    n, df = frequencies(passages, terms)
    score = sum((F.when(_has(t), w).otherwise(0.0) for t, w in sorted(weights(n, df).items())), F.lit(0.0))
    score = score * F.when(_blob().rlike(r"\d"), 1.6).otherwise(1.0) * F.when(F.col("kind") == "measurement", 1.3).otherwise(1.0)
    rows = passages.withColumn("rank", F.round(score, 9)).where(F.greatest(F.lit(False), *map(_has, terms))).withColumn("doc", T.clean_name(F.col("doc_name")))
    once = retrieval.best_per_key(rows.withColumn("opening", F.left(F.coalesce("snippet", "text"), F.lit(60))), ["doc", "opening"], [F.desc("rank"), F.asc("id")])
    return once.orderBy(F.desc("rank"), "id").limit(limit).select("id", "kind", "text", F.left(F.coalesce("snippet", "text"), F.lit(300)).alias("snippet"), "doc", "rank")


@dataclass
class Found:
    passages: DataFrame
    terms: list[str]
    expanded: list[str]
    note: str | None = None


def search(passages: DataFrame, query: str, limit: int = 10, synonyms: Synonyms | None = None, vector: list[float] | None = None, kinds: list[str] | None = None) -> Found:
    """Passages for a question, or none and a note if at least half of its terms, of two or more, are nowhere in the corpus."""
    synonyms = synonyms or Synonyms()
    terms = content_terms(query)
    empty = passages.limit(0).select("id", "kind", "text", "snippet", F.lit("").alias("doc"), F.lit(0.0).alias("rank"))
    if not terms:
        return Found(empty, [], [])
    short = [t for t in dict.fromkeys(re.findall("[а-яёa-z0-9]{2,3}", query.lower())) if synonyms.known(t)]
    expanded = synonyms.expanded([*terms, *short])
    if len(terms) >= 2 and len(missing := absent(passages, terms, synonyms)) >= math.ceil(len(terms) / 2):
        return Found(empty, terms, expanded, "в корпусе нет данных по: " + ", ".join(missing[:6]))
    rows = passages if kinds is None else passages.where(F.col("kind").isin(kinds))
    found = hybrid(rows, expanded, limit, vector) if "embedding" in passages.columns else boosted(rows, expanded, limit)
    return Found(found, terms, expanded)


def post_filter(rows: DataFrame, kinds: list[str] | None = None, year_from: int | None = None, year_to: int | None = None, home: str | None = None) -> DataFrame:
    """Rows of the kinds; of years and at home (RU by language or country) only those known to be otherwise go."""
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    if year_from is not None:
        rows = rows.where(F.coalesce(F.col("year") >= year_from, F.lit(True)))
    if year_to is not None:
        rows = rows.where(F.coalesce(F.col("year") <= year_to, F.lit(True)))
    if home:
        known = F.col("country").isNotNull() | F.col("lang").isNotNull()
        at_home = F.coalesce(F.col("lang") == "ru", F.lit(False)) | F.coalesce(F.col("country") == "RU", F.lit(False))
        rows = rows.where(~known | (at_home if home == "RU" else ~at_home))
    return rows


def over_fetch(limit: int, filters: bool) -> int:
    """Rows to ask for when filters follow."""
    return min(3 * limit, 60) if filters else limit


def measurements(results: DataFrame, quantity: str, low: float | None = None, high: float | None = None, query: str | None = None, limit: int = 20) -> DataFrame:
    """results(kind, low, nominal, high, unit, snippet, doc_name) of a quantity in a range of its own unit, by value.

    Units that can't be converted are left out; words of the query narrow the rows by snippet and document unless none would be left.
    """
    value = numeric.measured(F.coalesce("nominal", (F.col("low") + F.col("high")) / 2, "low", "high"), F.col("unit"), quantity)
    rows = results.where(F.col("kind") == quantity).withColumn("canonical", value).where("canonical is not null")
    if low is not None:
        rows = rows.where(F.col("canonical") >= low)
    if high is not None:
        rows = rows.where(F.col("canonical") <= high)
    terms = content_terms(query or "")
    if terms:
        blob = F.lower(F.concat_ws(" ", "snippet", "doc_name"))
        hit = F.greatest(F.lit(False), *(T.stemmed_in(blob, F.lit(t)) for t in terms))
        narrowed = rows.where(hit)
        rows = rows if narrowed.isEmpty() else narrowed
    once = retrieval.best_per_key(rows.withColumn("opening", F.left("snippet", F.lit(60))), ["doc_name", "opening"], [F.asc("canonical"), F.asc("unit")])
    return once.drop("opening").orderBy("canonical", "doc_name", "snippet").limit(limit)


def entities(query: str, aliases: DataFrame) -> dict[str, list[str]]:
    """Names that a question holds, of aliases(kind, name, alias): two adjacent words by an alias that has them, single words by one that they are; at most four of each kind."""
    terms = content_terms(query)[:10]
    pairs = [f"{a} {b}" for a, b in zip(terms, terms[1:])][:8]
    low = F.lower("alias")
    exact = low.isin([*terms, *pairs]) if terms else F.lit(False)
    held = F.greatest(F.lit(False), *(F.contains(low, F.lit(p)) for p in pairs))
    order = F.struct((~held).alias("a"), (~exact).alias("b"), F.length("alias").alias("c"), "name")
    rows = aliases.where(exact | held).groupBy("kind", "name").agg(F.min(order).alias("o"))
    best = retrieval.best_per_key(rows, ["kind", "name"], [F.asc("o")])
    out: dict[str, list[str]] = {}
    for r in best.orderBy("kind", "o").collect():  # names that one question can hold
        out.setdefault(r["kind"], []).append(r["name"])
    return {k: v[:4] for k, v in out.items()}


def alias_resolve(aliases: DataFrame, wanted: str) -> DataFrame:
    """The name of the alias that is the text, else of the shortest alias that holds it: one row at most."""
    low, want = F.lower("alias"), wanted.lower()
    return aliases.where(F.contains(low, F.lit(want))).orderBy((low == want).desc(), F.length("alias"), "alias", "name").limit(1)


# -- over a graph -------------------------------------------------------------------------


def titled(docs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(doc_id, matched): documents whose id holds two of the terms (one, if there is but one), by how many, then by length of text."""
    hits = F.size(F.filter(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(F.lower("doc_id"), t)))
    rows = docs.withColumn("matched", hits).where(F.col("matched") >= (2 if len(terms) > 1 else 1))
    return rows.orderBy(F.desc("matched"), F.length("text"), "doc_id").limit(limit).select("doc_id", "matched")


def find_anchors(nodes: DataFrame, terms: list[str], each: int = 5) -> DataFrame:
    """(term, text, type, sources): for each term the nodes that hold it, the exact first, then the shortest."""
    asked = F.explode(F.filter(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(F.lower("text"), t)))
    rows = nodes.select("text", "type", "sources", asked.alias("term"))
    rows = rows.withColumn("exact", F.lower("text") == F.col("term"))
    ranked = retrieval.best_per_key  # noqa: F841  the order is that of a bounded top within each term
    from pyspark.sql import Window

    order = Window.partitionBy("term").orderBy(F.desc("exact"), F.length("text"), "text", "type")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).drop("r")


def graph_search(nodes: DataFrame, edges: DataFrame, material: str | None = None, regime: str | None = None, prop: str | None = None, limit: int = 50) -> DataFrame:
    """Edges out of nodes that hold the material or the regime, to targets that hold the property, of sources that touch the regime; an absent one asks nothing."""
    holds = lambda c, x: F.lit(True) if x is None else F.contains(F.lower(c), F.lit(x.lower()))
    at = nodes.where(holds("text", material) if material or not regime else holds("text", regime)).select(F.col("text").alias("src"))
    out = edges.join(at.distinct(), "src", "left_semi").where(holds("dst", prop))
    if regime:
        ends = edges.where(holds("src", regime)).select(F.col("dst").alias("src")).unionByName(edges.where(holds("dst", regime)).select("src")).distinct()
        out = out.join(ends, "src", "left_semi")
    return out.orderBy("src", "predicate", "dst").limit(limit)


def graph_gaps(nodes: DataFrame, edges: DataFrame, regime: str | None = None) -> DataFrame:
    """(gap): materials that produce no output, and a regime linked to no material."""
    lone = nodes.where("type = 'MATERIAL'").select(F.col("text").alias("src")).distinct().join(edges.where("predicate = 'produces_output'").select("src"), "src", "left_anti")
    out = lone.select(F.concat(F.lit("material without effects: "), "src").alias("gap"))
    if regime and edges.where("predicate = 'uses_material'").isEmpty():
        out = out.unionByName(nodes.sparkSession.range(1).select(F.lit(f"regime linked to no material: {regime}").alias("gap")))
    return out


def source_ranks(anchors: DataFrame) -> DataFrame:
    """(doc_id, relevance, coverage) of anchors(term, text, sources, bonus): per term and document the anchor of fewest sources counts its bonus over their number."""
    rows = anchors.select("term", "text", "bonus", F.size("sources").alias("n"), F.explode("sources").alias("doc_id"))
    best = retrieval.best_per_key(rows, ["term", "doc_id"], [F.asc("n"), F.asc("text")])
    return best.groupBy("doc_id").agg(F.sum(F.col("bonus") / F.col("n")).alias("relevance"), F.count("*").alias("coverage"))


def graph_retrieve(nodes: DataFrame, edges: DataFrame, docs: DataFrame, question: str, lemmas: dict[str, str] | None = None, vector_nodes: DataFrame | None = None, hops: int = 2, most_nodes: int = 50, depth: int = 8, texts: int = 7, chars: int = 6000, stop: list[str] | None = None) -> dict:
    """Nodes, edges and text windows for a question.

    Anchors: nodes that hold a term, and vector_nodes(text, type, sources). They are expanded in order of match (exact term,
    lemma, part), channel, most terms covered by one of their documents and fewest sources, along paths that share a source
    with them, until ``most_nodes``. Documents are ranked four ways (title 2, content 1.5, specificity 1, coverage 1) and
    fused from rank 0; the first ``texts`` give windows. outcome: strong, weak or no_anchor by the share of terms in them.
    """
    lemmas = lemmas or {}
    words = content_terms(question)
    symbols = [t for t in re.findall(r"[A-Za-z][a-z]?", question) if t in T.ELEMENTS]
    terms = list(dict.fromkeys([*words, *(lemmas[w] for w in words if w in lemmas)]))
    exact, forms = set(words), set(lemmas.get(w, w) for w in words)
    found = find_anchors(nodes, terms).withColumn("contains", F.lit(True))
    if vector_nodes is not None:
        found = found.unionByName(vector_nodes.select("text", "type", "sources").withColumns({"term": F.lit(None).cast("string"), "exact": F.lit(False), "contains": F.lit(False)}))
    low = F.lower("text")
    found = found.withColumn("match", F.when(low.isin(list(exact)), 0).when(low.isin(list(forms)), 1).otherwise(2)).withColumn("bonus", F.element_at(F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0)), F.col("match") + 1)).persist()
    ranks = source_ranks(found.where("contains")).persist()
    covered = found.select("text", "type", F.explode_outer("sources").alias("doc_id")).join(ranks.select("doc_id", "coverage"), "doc_id", "left").groupBy("text", "type").agg(F.coalesce(F.max("coverage"), F.lit(0)).alias("covered"))
    once = found.groupBy("text", "type", "sources", "match").agg(F.max("contains").alias("contains")).join(covered, ["text", "type"])
    order = once.orderBy("match", F.desc("contains"), F.desc("covered"), F.size("sources"), "text", "type").collect()  # at most five a term, and the vector nodes
    seen: dict[str, None] = {}
    used = None
    for a in order:
        start = nodes.sparkSession.createDataFrame([(a["text"], a["sources"])], "node string, sources array<string>")
        near = graph.neighbourhood_edges(edges.select("src", "dst", "predicate", "sources"), start, hops, same_source=True).persist()
        for r in near.select("src", "dst").collect():  # 200 at most
            seen.update({r["src"]: None, r["dst"]: None})
        used = near if used is None else used.unionByName(near)
        if len(seen) >= most_nodes:
            break
    kept = [t for t in seen if len(t.strip()) >= 3 and t.strip().lower() not in (stop or [])][:most_nodes]
    node_rows = nodes.where(F.col("text").isin(kept)) if kept else nodes.limit(0)
    edge_rows = used.where(F.col("src").isin(kept) & F.col("dst").isin(kept)).distinct() if used is not None and kept else edges.limit(0).select("src", "dst", "predicate")
    specific = ranks.orderBy(F.desc("relevance"), F.desc("coverage"), "doc_id").limit(depth).withColumn("score", F.col("relevance"))
    coverage = ranks.orderBy(F.desc("coverage"), F.desc("relevance"), "doc_id").limit(depth)
    by = lambda df, *keys: retrieval.ranked(df.withColumn("order", F.struct(*keys)), "order", "doc_id", 0).select("doc_id", "rank")
    bm = retrieval.top(retrieval.bm25(docs, [t for t in dict.fromkeys([*(t for t in terms if len(t) >= 4), *(s.lower() for s in symbols)])] or [""]), "score", "doc_id", depth)
    title = titled(docs, terms, depth).join(docs.select("doc_id", (-F.length("text")).alias("shorter")), "doc_id") if terms else docs.limit(0).select("doc_id", F.lit(0).alias("matched"), F.lit(0).alias("shorter"))
    channels = [(by(title, "matched", "shorter"), 2.0), (by(bm, "score"), 1.5), (by(specific, "relevance", "coverage"), 1.0), (by(coverage, "coverage", "relevance"), 1.0)]
    fused = retrieval.top(retrieval.rrf(channels, "doc_id"), "score", "doc_id", texts).persist()
    shown = fused.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "score", pages.relevant_window(F.col("text"), [*terms, *symbols], chars).alias("window")).persist()
    wanted = exact | forms | {s.lower() for s in symbols}
    blob = shown.agg(F.lower(F.array_join(F.collect_list("window"), "\n")).alias("b")).select(*(F.contains("b", F.lit(w)).alias(f"w{i}") for i, w in enumerate(sorted(wanted)))).first() if wanted else []
    relevance = sum(map(bool, blob)) / len(wanted) if wanted else 0.0
    outcome = "no_anchor" if not order and fused.isEmpty() else "strong" if relevance >= 0.15 else "weak"
    return {"nodes": node_rows, "edges": edge_rows, "sources": fused, "windows": shown, "relevance": relevance, "outcome": outcome}


# Words of a question -> tool, in the order in which they are tried.
INTENTS = [
    (("противореч", "расхожден", "конфликт"), "find_contradictions"), (("пробел", "не изучен", "нет данных"), "find_gaps"), (("эксперт", "кто занимался", "лаборатор"), "find_experts_by_topic"),
    (("сравни", " vs ", "против", "отечествен", "зарубеж"), "compare_practice"), (("обзор", "литератур", "что известно"), "literature_review"),
    (("покрыти", "статистик", "сколько в базе"), "coverage"), (("истори", "цепочк", "из чего получ"), "lineage"),
]
_LISTS = ("метод", "способ", "техническ", "технолог", "какие", "перечисл", "варианты", "виды", "существ", "применяют", "решени")


def intent(question: Column, kind: Column) -> Column:
    """struct(tool, op, value): the tool a question asks for; a question about a kind of quantity asks for evidence, with its bound, any other for passages."""
    low = F.lower(question)
    has = lambda words: F.greatest(F.lit(False), *(F.contains(low, F.lit(w)) for w in words))
    tool = F.when(kind.isNotNull() & (kind != "") & ~has(_LISTS), "evidence").otherwise("search_passages")
    for words, name in reversed(INTENTS):
        tool = F.when(has(words), name).otherwise(tool)
    most, least = r"(?:не более|≤|<=|менее)\s*(\d[\d.,]*)", r"(?:не менее|≥|>=|более|свыше)\s*(\d[\d.,]*)"
    number = lambda p: F.replace(F.regexp_extract(low, p, 1), F.lit(","), F.lit(".")).try_cast("double")
    asked = tool == "evidence"
    return F.struct(tool.alias("tool"), F.when(asked & low.rlike(least), ">=").when(asked & low.rlike(most), "<=").alias("op"), F.when(asked, F.coalesce(number(least), number(most))).alias("value"))
