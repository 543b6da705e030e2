"""Acronyms, term tables and synonym clusters mined from a corpus.

Scanning a text for definitions is a state machine over its characters and runs in Arrow
batches; counting, choosing and joining what was found are DataFrame aggregations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamlode.functions import text as T
from seamlode.functions.arrow import arrow

_INSIDE = re.compile(r"[(\[]\s*([^()\[\]]{2,120}?)\s*[)\]]")
_FORMULA = re.compile(r"[(\[{]?(?:[A-Z][a-z]?\d*|\([A-Za-z0-9]+\)\d*)+[)\]}]?[,;.]?")


def is_short_form(token: str) -> bool:
    """Two to ten signs, a letter among them, and not a plain lower-case word."""
    return bool(re.fullmatch(r"[\w\-/.]{2,10}", token)) and any(map(str.isalpha, token)) and not (token.islower() and not any(map(str.isdigit, token)))


def is_chemistry(short: str, long: str) -> bool:
    """Whether a definition reads as an equation, an ion or formulas rather than words."""

    def formula(w: str) -> bool:
        return any(map(str.isdigit, w.strip("()[]{},;:.«»"))) and bool(_FORMULA.fullmatch(w))

    words = long.split()
    named = len(re.findall(r"[^\W\d_]{3,}", long))
    return (
        (any(map(str.isdigit, short)) and bool(re.fullmatch(r"(?:[A-Z][a-z]?\d*){2,}", short))) or bool(set(long) & set("={}*→·•∙+")) or bool(re.search(r"\d\s*[+-](?:\s|,|;|$)", long))
        or not words or formula(words[0]) or not named or sum(map(formula, words)) > named
    )


def long_form(short: str, context: str) -> str | None:
    """The end of the context that holds the short form's letters in order, from the start of a word; None if it doesn't, is shorter, or has too many words."""
    at = len(context)
    low = context.lower()
    letters = [c for c in short.lower() if c.isalnum()]
    for c in reversed(letters):
        at = low.rfind(c, 0, at)
        if at < 0:
            return None
    if not letters:
        return None
    while at and not context[at - 1].isspace():
        at -= 1
    found = context[at:].strip()
    return found if len(found) >= len(short) and 0 < len(found.split()) <= len(short) + 5 else None


def definitions(text: str) -> list[tuple[str, str]]:
    """(short form, long form) pairs defined in a text, either of them in brackets; the first of each short form."""
    found: dict[str, str] = {}
    for m in _INSIDE.finditer(text):
        inner = m[1].strip()
        before = re.split(r"[.;:!?]\s|\n", text[: m.start()])[-1].strip()
        if is_short_form(inner) and (long := long_form(inner, before)) and not is_chemistry(inner, long):
            found.setdefault(inner, long)
            continue
        short = (before.split() or [""])[-1].strip(",;:")
        if is_short_form(short) and len(inner.split()) >= 2 and (long := long_form(short, inner)) and not is_chemistry(short, long):
            found.setdefault(short, long)
    return list(found.items())


def initial_share(acronym: str, expansion: str) -> float:
    """Share of the acronym's letters that begin words of the expansion, in order."""
    letters, initials = [c for c in acronym.lower() if c.isalnum()], iter(w[0].lower() for w in expansion.split())
    hits, rest = 0, list(initials)
    for c in letters:
        if c in rest:
            rest = rest[rest.index(c) + 1 :]
            hits += 1
        else:
            rest = []
    return hits / len(letters) if letters else 0.0


@arrow("array<struct<short:string,long:string>>")
def definitions_in(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All definitions of each text."""
    for t in texts:
        yield t.map(lambda x: None if x is None else [{"short": a, "long": b} for a, b in definitions(x)])


@arrow("double")
def initials_covered(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, e in batches:
        yield pd.Series([initial_share(x, y) for x, y in zip(a, e)], dtype=float)


def defined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, short, long) of every definition."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(definitions_in(F.col(text_col))).alias("place", "d")).select("doc_id", "place", "d.short", F.trim(F.regexp_replace("d.long", r"\s+", " ")).alias("long"))


def first_definitions(found: DataFrame) -> DataFrame:
    """(short, long): of each short form the first long form by document and place."""
    return found.groupBy("short").agg(F.min_by("long", F.struct("doc_id", "place")).alias("long"))


def abbreviations(found: DataFrame) -> DataFrame:
    """One row an acronym of found(doc_id, short, long): the sense of most documents, its commonest form, all forms and a confidence.

    Forms that differ in case endings are one sense. Of senses of equally many documents that of the shorter form wins, then
    the smaller; so of forms. An acronym whose form is junk is left out.
    """
    forms = found.groupBy("short", "long").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs")).withColumn("sense", T.phrase_stem(F.col("long")))
    in_docs = found.withColumn("sense", T.phrase_stem(F.col("long"))).groupBy("short", "sense").agg(F.count_distinct("doc_id").alias("n_docs"))
    best = F.min(F.struct((-F.col("docs")).alias("down"), F.length("long").alias("size"), F.col("long").alias("long")))
    senses = forms.groupBy("short", "sense").agg(F.array_sort(F.collect_set("long")).alias("expansion_variants"), F.sum("uses").alias("n_occurrences"), F.min(F.length("long")).alias("shortest"), best.alias("best"))
    order = Window.partitionBy("short").orderBy(F.desc("n_docs"), "shortest", "sense")
    top = senses.join(in_docs, ["short", "sense"]).withColumn("r", F.row_number().over(order)).where("r = 1")
    top = top.select(F.col("short").alias("acronym"), F.col("best.long").alias("canonical_expansion"), "expansion_variants", "n_occurrences", "n_docs")
    top = top.where(~T.junk_abbreviation(F.col("acronym"), F.col("canonical_expansion")))
    covered = initials_covered("acronym", "canonical_expansion")
    confidence = F.round(F.least(F.lit(1.0), covered * 0.6 + F.least(F.lit(1.0), F.col("n_docs") / 2.0) * 0.4), 3)
    return top.withColumn("lang", F.when(F.col("canonical_expansion").rlike("[Ѐ-ӿ]"), "ru").otherwise("en")).withColumn("confidence", confidence)


def best_scores(terms: DataFrame) -> DataFrame:
    """Of terms(term, score) the best-scored row of each term, case aside; ties to the smaller form."""
    return terms.groupBy(F.lower("term").alias("key")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("term").alias("term"))).alias("b")).select("b.term", (-F.col("b.s")).alias("score"))


def term_table(terms: DataFrame) -> DataFrame:
    """terms(term, label, source, place) as one row a term, case aside: the first form, all sources, the first known label."""
    known = F.when(F.col("label") != "UNKNOWN", F.col("label"))
    rows = terms.where(F.trim("term") != "").withColumn("term", F.trim("term")).groupBy(F.lower("term").alias("key"))
    return rows.agg(F.min_by("term", "place").alias("term"), F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("place"))), F.lit("UNKNOWN")).alias("label"), F.array_sort(F.collect_set("source")).alias("sources"))


def declension_dedup(terms: DataFrame) -> DataFrame:
    """terms(term, label, sources) with ``dropped_for``: of forms of one word and label the shortest stays, then that of most sources, then the smaller."""
    keyed = terms.withColumn("stem", T.declension_key(F.col("term")))
    group = Window.partitionBy("label", "stem").orderBy(F.length("term"), F.desc(F.size("sources")), "term")
    first = F.first("term").over(group)
    return keyed.withColumn("dropped_for", F.when(F.col("stem").isNotNull() & (first != F.col("term")), first)).drop("stem")


def must_links(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """The pairs(a, b, method) whose ends are both among terms(term)."""
    have = terms.select("term").distinct()
    return pairs.join(have.withColumnRenamed("term", "a"), "a", "left_semi").join(have.withColumnRenamed("term", "b"), "b", "left_semi").where("a <> b")


def lexical_pairs(terms: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, ratio), a < b: terms(term) whose transliterations are alike by edit distance.

    Blocked, not all against all: of two strings within k edits of n letters one of k + 1 equal parts of the one stands
    in the other near its place, so strings meet by the parts of the shorter and the pieces of that size of the longer.
    """
    keyed = terms.select("term").distinct().withColumn("key", T.transliterated(F.col("term"))).where("key <> ''").withColumn("n", F.length("key"))
    most = F.floor(F.col("size") * (1 - least)).cast("int")  # edits allowed when the longer has this size
    # the longer of a pair has at most n / least letters
    sized = keyed.select("term", "key", "n", F.explode(F.sequence("n", F.floor(F.col("n") / least).cast("int"))).alias("size")).withColumn("k", most)
    step = lambda i: F.floor(i * F.col("n") / (F.col("k") + 1)).cast("int")
    parts = sized.select("term", "key", "size", "k", F.explode(F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(step(i).alias("at"), F.substring("key", step(i) + 1, step(i + 1) - step(i)).alias("part")))).alias("p"))
    parts = parts.select("term", "key", "size", "k", "p.at", "p.part").distinct()
    lengths = parts.select("size", "k", F.length("part").alias("w")).distinct()
    pieces = keyed.withColumnRenamed("n", "size").join(lengths, "size").select(F.col("term").alias("other"), F.col("key").alias("other_key"), "size", "w", "k")
    pieces = pieces.select("other", "other_key", "size", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.col("size") - F.col("w"), F.lit(0))), lambda i: F.struct(i.alias("place"), F.substring("other_key", i + 1, F.col("w")).alias("part")))).alias("q"))
    pieces = pieces.select("other", "other_key", "size", "q.place", "q.part").distinct()
    met = parts.join(pieces, ["size", "part"]).where((F.abs(F.col("place") - F.col("at")) <= F.col("k")) & (F.col("term") != F.col("other")))
    pairs = met.select(F.least("term", "other").alias("a"), F.greatest("term", "other").alias("b"), F.when(F.col("term") < F.col("other"), F.col("key")).otherwise(F.col("other_key")).alias("x"), F.when(F.col("term") < F.col("other"), F.col("other_key")).otherwise(F.col("key")).alias("y")).distinct()
    return pairs.withColumn("ratio", T.edit_ratio(F.col("x"), F.col("y"))).where(F.col("ratio") >= least).select("a", "b", "ratio")


def clusters(terms: DataFrame, similar: DataFrame, musts: DataFrame, lexical: DataFrame | None = None, threshold: float = 0.80, accept: float = 0.9, most: int = 25) -> DataFrame:
    """(term, cluster, canonical, label, min_edge, review) of terms(term, label).

    musts(a, b, method) are joined whatever else holds and make ground groups. similar(a, b, weight) and lexical(a, b, ratio)
    join two clusters, strongest first, if their known labels agree, not both have different ground groups, they have at most
    ``most`` terms together, and every pair across them is similar, a lexical edge's own pair aside. Terms of two signs
    are joined by musts only. Components of all edges go to a task each, where the joins run one after another.
    """
    from pyspark.sql import types as K

    from seamlode.operators.graph import components

    edges = musts.select("a", "b", F.lit(1.0).alias("w"), F.lit(0).alias("kind"))
    edges = edges.unionByName(similar.where(F.col("weight") >= threshold).select("a", "b", F.col("weight").alias("w"), F.lit(1).alias("kind")))
    if lexical is not None:
        edges = edges.unionByName(lexical.select("a", "b", F.col("ratio").alias("w"), F.lit(2).alias("kind")))
    of = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = terms.join(of.withColumnRenamed("node", "term"), "term", "left").withColumn("block", F.coalesce("root", "term")).select("block", F.col("term").alias("a"), F.col("label").alias("b"), F.lit(0.0).alias("w"), F.lit(-1).alias("kind"))
    rows = rows.unionByName(edges.join(of.select(F.col("node").alias("a"), F.col("root").alias("block")), "a").select("block", "a", "b", "w", "kind"))
    schema = K.StructType.fromDDL("term string, cluster string, canonical string, label string, min_edge double, review boolean")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_clustered(pdf, threshold, accept, most), columns=schema.fieldNames())

    return rows.groupBy("block").applyInPandas(one, schema)


def _clustered(rows: pd.DataFrame, threshold: float, accept: float, most: int) -> list[tuple]:
    label = {r.a: r.b for r in rows[rows.kind == -1].itertuples()}
    near = {frozenset((r.a, r.b)): r.w for r in rows[rows.kind == 1].itertuples()}
    group = {t: t for t in label}
    members = {t: [t] for t in label}
    labels = {t: {x} - {"UNKNOWN", None} for t, x in label.items()}
    ground: dict[str, set[int]] = {t: set() for t in label}
    used: list[tuple[str, float]] = []

    def join(a: str, b: str) -> None:
        x, y = group[a], group[b]
        for t in members[y]:
            group[t] = x
        members[x] += members.pop(y)
        labels[x] |= labels.pop(y)
        ground[x] |= ground.pop(y)

    musts = sorted((r.a, r.b) for r in rows[rows.kind == 0].itertuples() if r.a in label and r.b in label and r.a != r.b)
    for i, (a, b) in enumerate(musts):
        ground[a].add(i)
        ground[b].add(i)
    for a, b in musts:
        if group[a] != group[b]:
            join(a, b)
        used.append((a, 1.0))

    def may(a: str, b: str, spare: bool) -> bool:
        x, y = group[a], group[b]
        if x == y or len(labels[x] | labels[y]) > 1 or (ground[x] and ground[y] and ground[x] != ground[y]) or len(members[x]) + len(members[y]) > most:
            return False
        return all(near.get(frozenset((s, t)), 0.0) >= threshold or (spare and {s, t} == {a, b}) for s in members[x] for t in members[y])

    for kind in (1, 2):
        found = [(r.w, min(r.a, r.b), max(r.a, r.b)) for r in rows[rows.kind == kind].itertuples() if r.a in label and r.b in label]
        for w, a, b in sorted(found, key=lambda e: (-e[0], e[1], e[2])):
            if min(len(a.strip()), len(b.strip())) > 2 and may(a, b, kind == 2):
                join(a, b)
                used.append((a, w if kind == 1 else max(near.get(frozenset((a, b)), 0.0), 0.85)))
    weakest: dict[str, float] = {}
    for a, w in used:
        weakest[group[a]] = min(weakest.get(group[a], 1.0), w)
    out = []
    for root, own in members.items():
        known = [label[t] for t in own if label[t] not in ("UNKNOWN", None)]
        latin = [t for t in own if all(ord(c) < 128 or not c.isalpha() for c in t)] or own
        spelled = [t for t in latin if not (t.isupper() and 2 <= len(t) <= 5)] or latin
        canonical = min(spelled, key=lambda t: (len(t), t.lower(), t))
        chosen = min(set(known), key=lambda x: (-known.count(x), x)) if known else "UNKNOWN"
        least = round(weakest.get(root, 1.0), 4)
        review = (len(own) > 1 and least < accept) or len(set(known)) > 1
        out += [(t, min(own), canonical, chosen, least, review) for t in own]
    return out


def merged_groups(groups: DataFrame, most: int = 12) -> DataFrame:
    """(forms): groups(forms) that share a form as one, of two to ``most`` forms; a form of other signs than letters and digits needs a blank or hyphen."""
    from seamlode.operators.graph import components

    good = lambda f: F.contains(f, F.lit(" ")) | F.contains(f, F.lit("-")) | f.rlike("(?iu)^[а-яёa-z0-9]+$")
    kept = groups.select(F.array_distinct(F.filter("forms", good)).alias("forms")).where(F.size("forms") >= 2)
    edges = kept.select(F.explode(F.slice("forms", 2, F.size("forms"))).alias("dst"), F.element_at("forms", 1).alias("src"))
    return components(edges.select("src", "dst")).groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("forms")).where(F.size("forms").between(2, most)).select("forms")


def mixed_scripts(forms: Column) -> Column:
    """Whether forms are of both Latin and Cyrillic letters."""
    whole = F.array_join(forms, " ")
    return whole.rlike("[а-яёА-ЯЁ]") & whole.rlike("[A-Za-z]")


def exports(concepts: DataFrame, registry: DataFrame, foes: list[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Tables of a glossary: entity_aliases, same_as, enrichment of a registry and proposed entries.

    concepts(concept_id, canonical, label, members array<struct<term, sources>>, edges array<struct<a, b, confidence, method>>);
    registry(name, aliases). A concept is of the entry that most of its forms name; its other forms enrich it unless they are
    its aliases already, name another entry, or are a pair of ``foes``. Concepts of no entry are proposed, one a canonical name.
    """
    forms = concepts.select("concept_id", "canonical", "label", F.explode("members").alias("m")).select("concept_id", "canonical", "label", "m.term", "m.sources")
    aliases = forms.select("label", F.col("concept_id").alias("entity_id"), F.col("term").alias("alias"), F.when(F.size("sources") > 0, F.array_join("sources", "|")).otherwise("term_dict").alias("source"))
    ends = concepts.select("concept_id", "canonical", "label", F.explode("edges").alias("e"))
    ends = ends.select("concept_id", "canonical", "label", F.explode(F.array("e.a", "e.b")).alias("term"), "e.confidence", "e.method").where("term <> canonical")
    same = ends.groupBy("concept_id", "label", "canonical", "term").agg(F.min(F.struct((-F.col("confidence")).alias("down"), "method")).alias("b"))
    same = same.select("label", F.col("term").alias("source_alias"), F.col("canonical").alias("canonical_alias"), (-F.col("b.down")).alias("confidence"), "b.method")
    known = registry.select("name", F.explode(F.concat(F.array("name", F.replace("name", F.lit("_"), F.lit(" "))), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    known = known.groupBy(F.lower(F.trim("alias")).alias("key")).agg(F.min("name").alias("entry")).cache()
    hits = forms.withColumn("key", F.lower("term")).join(known, "key").groupBy("concept_id", "entry").agg(F.count("*").alias("n"))
    words = forms.select("concept_id", F.explode(F.split(F.lower("term"), r"\s+")).alias("key")).join(known, "key").groupBy("concept_id", "entry").agg(F.count("*").alias("n"))
    hits = hits.unionByName(words.join(hits.select("concept_id").distinct(), "concept_id", "left_anti"))
    entry = hits.groupBy("concept_id").agg(F.min(F.struct((-F.col("n")).alias("down"), "entry")).alias("b")).select("concept_id", "b.entry")
    foe = F.lit(False)
    for name, form in foes or []:
        foe = foe | ((F.col("entry") == name) & (F.col("key") == form))
    more = forms.withColumn("key", F.lower("term")).join(entry, "concept_id").join(known.withColumnRenamed("entry", "owner"), "key", "left").where(F.col("owner").isNull() & ~foe)
    more = more.groupBy("entry").agg(F.array_sort(F.collect_set("term")).alias("aliases"))
    new = forms.join(entry, "concept_id", "left_anti").groupBy(F.lower("canonical").alias("key")).agg(F.min("canonical").alias("canonical"), F.array_sort(F.collect_set("term")).alias("surface_forms"))
    return {"entity_aliases": aliases, "entity_same_as": same, "alias_enrichment": more, "proposed": new.drop("key")}
