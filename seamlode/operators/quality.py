"""Scores of answers against expectations, and their aggregation over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamlode.functions import numeric
from seamlode.functions import text as T
from seamlode.operators import retrieval

# Weights of the metrics, and patterns of numbers, citations and patents.
WEIGHTS = {"keywords": 0.25, "numeric": 0.25, "provenance": 0.30, "mode": 0.10, "latency": 0.10}
NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
CITATION = r"(?iu)источник\s*[:—-]"
PATENT = r"(?iu)(пат\.?\s|патент[а-яё]*|а\.?\s?с\.?\s|авторск[а-яё]+\s+свидетельств[а-яё]*|\bRU\s?\d{6,7}|\bSU\s?\d{6,7})"
PATENT_NUMBER = r"(?iu)(?:RU|SU)?\s?\d{6,7}\s?[СCАA]\d?"
REFERENCE = r"\[\d+(?:\s*[,;–-]\s*\d+)*\]"
DOI = r"10\.\d{4,9}/[^\s\"<>]+"


def numbers(text: Column) -> Column:
    """Numbers of a text, references in brackets aside, a comma being a point."""
    found = T.found_all(F.regexp_replace(F.coalesce(text, F.lit("")), REFERENCE, " "), NUMBER)
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def dois(text: Column) -> Column:
    return F.transform(T.found_all(text, DOI), lambda x: F.regexp_replace(x, r"[.,;)\]]+$", ""))


def patent_numbers(text: Column) -> Column:
    return F.transform(T.found_all(text, PATENT_NUMBER), lambda x: F.trim(x))


def value_units(text: Column, units: list[str]) -> Column:
    """array<struct(value, unit)>: numbers before one of the units."""
    unit = "|".join(sorted(map(_quoted, units), key=len, reverse=True))
    pattern = rf"(\d+(?:[.,]\d+)?)\s*({unit})"
    return F.transform(T.found_all(text, pattern), lambda m: F.struct(F.replace(F.regexp_extract(m, pattern, 1), F.lit(","), F.lit(".")).cast("double").alias("value"), F.regexp_extract(m, pattern, 2).alias("unit")))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in s)


def flattened(answers: DataFrame) -> DataFrame:
    """answers(summary, claims array<struct<text, experiment_ids>>, ...) with their whole text and what it holds."""
    texts = F.filter(F.concat(F.array(F.coalesce("summary", F.lit(""))), F.transform(F.coalesce("claims", F.array()), lambda c: F.coalesce(c["text"], F.lit("")))), lambda t: t != "")
    rows = answers.withColumn("text", F.array_join(texts, "\n"))
    ids = F.aggregate(F.coalesce("claims", F.array()), F.lit(0), lambda a, c: a + F.greatest(F.size(F.coalesce(c["experiment_ids"], F.array().cast("array<string>"))), F.lit(0)))
    return rows.withColumns({"n_numeric": F.size(numbers(F.col("text"))), "n_citations": F.size(T.found_all(F.col("text"), CITATION)), "n_experiment_ids": ids, "has_patent": F.col("text").rlike(PATENT)})


def _held(text: Column, words: Column) -> Column:
    """How many of an array's words a text has in any form."""
    low = F.lower(text)

    def has(w: Column) -> Column:
        t = F.lower(F.trim(w))
        n = F.length(t)
        return (t != "") & (F.contains(low, t) | ((n > 5) & F.contains(low, F.left(t, n - 2))) | ((n > 7) & F.contains(low, F.left(t, n - 3))))

    return F.size(F.filter(words, has))


def keyword_score(text: Column, any_of: Column, all_of: Column) -> Column:
    """Mean of whether any word of the one list is there and the share of the other's; null without either."""
    a = F.when(F.size(any_of) > 0, F.when(_held(text, any_of) > 0, 1.0).otherwise(0.0))
    b = F.when(F.size(all_of) > 0, _held(text, all_of) / F.size(all_of))
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def numeric_score(text: Column, expected: Column) -> Column:
    """Share of expected array<struct<value, op, value2, tol>> that is there; null without any."""
    found = numbers(text)

    def there(e: Column) -> Column:
        tol = F.coalesce(e["tol"], F.lit(0.0))
        allowed = F.when(tol > 0, tol).otherwise(F.greatest(F.lit(0.5), F.abs(e["value"]) * 0.02))
        near = F.exists(found, lambda n: F.abs(n - e["value"]) <= allowed)
        low, high = F.least(e["value"], e["value2"]), F.greatest(e["value"], e["value2"])
        slack = (high - low) * 0.02
        inside = F.exists(found, lambda n: (n >= low - slack) & (n <= high + slack))
        ends = F.exists(found, lambda n: F.abs(n - low) <= allowed) & F.exists(found, lambda n: F.abs(n - high) <= F.greatest(F.lit(0.5), F.abs(high) * 0.02))
        return F.when((e["op"] == "range") & e["value2"].isNotNull(), inside | ends).otherwise(near)

    return F.when(F.size(expected) > 0, F.size(F.filter(expected, there)) / F.size(expected))


def provenance_score(flat: dict[str, Column], sources: Column, patent: Column, citations: Column, values: Column) -> Column:
    """Mean of citations against those asked for, numbers against those asked for (3 for none), and a patent where one is; null where nothing is asked."""
    asked = (F.size(sources) > 0) | patent | (citations > 0) | (values > 0)
    named = _held(flat["text"], sources) > 0
    cited = (flat["n_citations"] > 0) | (flat["n_experiment_ids"] > 0) | named
    have = flat["n_citations"] + F.when(named, 1).otherwise(0)
    a = F.when(cited, F.least(F.lit(1.0), have / F.greatest(F.lit(1), citations))).otherwise(0.0)
    b = F.least(F.lit(1.0), flat["n_numeric"] / F.when(values > 0, values).otherwise(3))
    c = F.when(flat["has_patent"], 1.0).otherwise(0.0)
    return F.when(asked, F.when(patent, (a + b + c) / 3).otherwise((a + b) / 2))


def mode_score(mode: Column, tools: Column, want: Column, any_tool: Column) -> Column:
    """Mean of whether the mode is the expected one (auto: any) and whether an expected tool was used; null without either."""
    a = F.when(want != "auto", F.when(F.lower(F.coalesce(mode, F.lit(""))) == want, 1.0).otherwise(0.0))
    hit = F.exists(any_tool, lambda w: F.exists(tools, lambda t: F.contains(F.lower(t), F.lower(w))))
    b = F.when(F.size(any_tool) > 0, F.when(hit, 1.0).otherwise(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def honesty_score(text: Column, forbidden: Column) -> Column:
    """1 for an answer that says there are no data and has no forbidden word."""
    return F.when(T.says_no_data(text) & (_held(text, forbidden) == 0), 1.0).otherwise(0.0)


def question_score(scores: dict[str, Column], answerable: Column, honesty: Column) -> Column:
    """Weighted mean of the metrics that apply; honesty alone where there is no answer."""
    top = sum((F.coalesce(scores[m], F.lit(0.0)) * w for m, w in WEIGHTS.items() if m in scores), F.lit(0.0))
    base = sum((F.when(scores[m].isNotNull(), w).otherwise(0.0) for m, w in WEIGHTS.items() if m in scores), F.lit(0.0))
    return F.when(answerable, F.coalesce(F.try_divide(top, base), F.lit(0.0))).otherwise(F.coalesce(honesty, F.lit(0.0)))


def weighted_mean(value: str, weight: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0))


def by_category(results: DataFrame, least: float = 0.6) -> DataFrame:
    """results(category, ok, score, weight): number, answered, weighted score and share of passes of each category."""
    ok = results.where("ok").groupBy("category").agg(F.count("*").alias("ok"), F.round(weighted_mean("score", "weight"), 3).alias("score"), F.round(F.avg(F.when(F.col("score") >= least, 1.0).otherwise(0.0)), 3).alias("pass_rate"))
    n = results.groupBy("category").agg(F.count("*").alias("n"))
    return n.join(ok, "category", "left").select("category", "n", F.coalesce("ok", F.lit(0)).alias("ok"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("pass_rate", F.lit(0.0)).alias("pass_rate"))


def summary(results: DataFrame, least: float = 0.6) -> DataFrame:
    """One row: totals, weighted score, passes, share of answers with a source."""
    done = F.col("ok")
    base = F.sum(F.when(done, F.col("weight")))
    source = (F.col("n_citations") > 0) | (F.col("n_experiment_ids") > 0)
    answers = F.count(F.when(done & F.col("answerable"), 1))
    return results.agg(
        F.count("*").alias("n_total"), F.count(F.when(done, 1)).alias("n_ok"), F.round(F.coalesce(F.try_divide(F.sum(F.when(done, F.col("score") * F.col("weight"))), base), F.lit(0.0)), 3).alias("score"),
        F.count(F.when(done & (F.col("score") >= least), 1)).alias("n_passed"), F.round(numeric.share(F.count(F.when(done & F.col("answerable") & source, 1)), answers), 3).alias("source_coverage"),
    )


def latencies(results: DataFrame) -> DataFrame:
    """Mean, middle, 95th percentile by index and largest latency of answered questions."""
    counts = results.where("ok").groupBy(F.lit("all").alias("of"), "latency_s").agg(F.count("*").alias("n"))
    return retrieval.order_statistics(counts, "of", "latency_s", "n")


def worst(results: DataFrame, most: int = 8) -> DataFrame:
    return results.orderBy("score", "id").limit(most)


def selected(questions: DataFrame, categories: list[str] | None = None, ids: list[str] | None = None, lang: str | None = None, sample: int | None = None) -> DataFrame:
    """Questions of the categories, ids and language; the first ``sample`` of them by id."""
    if categories:
        questions = questions.where(F.col("category").isin(categories))
    if ids:
        questions = questions.where(F.col("id").isin(ids))
    if lang:
        questions = questions.where(F.col("lang") == lang)
    return questions.orderBy("id").limit(sample) if sample else questions


def report(results: DataFrame, title: str = "Benchmark") -> str:
    """The summary, the categories and the lowest scores as Markdown."""
    s = summary(results).first()
    lines = [f"# {title}", "", f"Score {s['score']}, {s['n_passed']} of {s['n_ok']} passed, {s['n_total'] - s['n_ok']} errors, sources {s['source_coverage']}", "", "| category | n | ok | score | pass rate |", "|-|-|-|-|-|"]
    lines += [f"| {r['category']} | {r['n']} | {r['ok']} | {r['score']} | {r['pass_rate']} |" for r in by_category(results).orderBy("category").collect()]  # a row a category
    lines += ["", "Lowest:", *(f"- {r['id']}: {r['score']}" for r in worst(results).collect())]
    return "\n".join(lines) + "\n"
