"""Lexical, dense and fused retrieval, and rank operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamlode.functions.text import terms


def postings(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, term, tf, size) of the query's terms; each text is split once."""
    rows = docs.select("doc_id", terms(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("size"), F.explode(F.filter("t", lambda x: x.isin(words))).alias("term"))
    return rows.groupBy("doc_id", "size", "term").agg(F.count("*").alias("tf"))


def idf(posts: DataFrame, total: DataFrame) -> DataFrame:
    """ln(1 + (N - df + 0.5) / (df + 0.5)) of each term; total(n) has one row."""
    df = posts.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _count(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def bm25(docs: DataFrame, words: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the documents with any of the terms.

    Each text is split once: a row a document holds its size and its counts of the terms, and the
    number of documents, their mean size and the terms' frequencies are one aggregate of those rows.
    """
    counts = F.array(*(_count(F.col("t"), w) for w in words))
    held = docs.select("doc_id", terms(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("size"), F.when(F.arrays_overlap("t", F.array(*map(F.lit, words))), counts).alias("tf"))
    held = held.persist()  # one row a document, without its text
    n, total, *found = held.agg(F.count("*"), F.sum("size"), *(F.count(F.when(F.col("tf")[i] > 0, 1)) for i in range(len(words)))).first()
    weights = F.array(*(F.log1p((F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5)) for df in found))
    mean = (total or 0) / n if n else 0.0
    part = lambda w, tf: F.when(tf > 0, w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.lit(mean)))).otherwise(0.0)
    score = F.aggregate(F.zip_with(weights, "tf", part), F.lit(0.0), lambda s, x: s + x)
    return held.where("tf is not null").select("doc_id", score.alias("score"))


def text_cosine(query: list[str], words: Column) -> Column:
    """Cosine of term counts of a query and an array of words; 0 if either is empty."""
    counts = {w: query.count(w) for w in dict.fromkeys(query)}
    if not counts:
        return F.lit(0.0)
    # one pass over the sorted words: inside a function of another array they would be split anew for each word
    start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("squares"), F.lit(0).cast("long").alias("dot"))

    def add(a: Column, w: Column) -> Column:
        n = F.when(a["word"] == w, a["n"] + 1).otherwise(F.lit(1).cast("long"))
        weight = F.lit(0).cast("long")
        for word, m in counts.items():
            weight = F.when(w == word, F.lit(m).cast("long")).otherwise(weight)
        return F.struct(w.alias("word"), n.alias("n"), (a["squares"] + 2 * n - 1).alias("squares"), (a["dot"] + weight).alias("dot"))

    def cosine(a: Column) -> Column:
        return F.try_divide(a["dot"].cast("double"), F.sqrt(a["squares"].cast("double")) * F.lit(sum(n * n for n in counts.values()) ** 0.5))

    return F.coalesce(F.aggregate(F.sort_array(words), start, add, cosine), F.lit(0.0))


def sparse(docs: DataFrame, query: list[str], k: int) -> DataFrame:
    """The k documents(doc_id, text) of the highest cosine of term counts, over 0."""
    asked = docs.select("doc_id", terms(F.col("text")).alias("t")).where(F.arrays_overlap("t", F.array(*map(F.lit, query)).cast("array<string>")))
    found = asked.select("doc_id", text_cosine(query, F.col("t")).alias("score")).where("score > 0")
    return top(found, "score", "doc_id", k)


def fuzzy(docs: DataFrame, query: str, k: int) -> DataFrame:
    """The k documents in which the query stands with the fewest edits, len / 4 at most (1 at least): 1 less edits over length."""
    low, most = query.lower(), max(1, len(query) // 4)

    @F.pandas_udf("int")
    def edits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else least_edits(low, t.lower()))

    found = docs.select("doc_id", edits("text").alias("edits")).where(F.col("edits") <= most)
    return top(found.select("doc_id", (1.0 - F.col("edits") / F.lit(max(len(low), 1))).alias("score")), "score", "doc_id", k)


def least_edits(pattern: str, text: str) -> int:
    """Fewest edits by which the pattern stands anywhere in the text: columns of the edit table as bit vectors (Myers, 1999)."""
    m = len(pattern)
    if not m:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = at.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        h_up = (down | ~(d0 | up)) & full
        h_down = up & d0
        score += 1 if h_up & last else -1 if h_down & last else 0
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full  # the pattern may begin anywhere, so nothing is carried in
        up = (h_down | ~(d0 | h_up)) & full
        down = h_up & d0
        best = min(best, score)
    return best


def reranked(candidates: DataFrame, query: list[str], k: int, own: float = 0.6) -> DataFrame:
    """The k of candidates(id, text, score) by 0.6 of their score and 0.4 of their cosine with the query."""
    score = F.col("score") * own + text_cosine(query, terms(F.col("text"))) * (1 - own)
    return top(candidates.withColumn("score", score), "score", "id", k)


def keep_last(channels: list[DataFrame], key: str) -> DataFrame:
    """Union of channels in which a later one's row of a key replaces an earlier one's."""
    rows = None
    for n, c in enumerate(channels):
        part = c.withColumn("_n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    return best_per_key(rows, [key], [F.desc("_n")]).drop("_n")


def ordered_union(*lists: Column) -> Column:
    """Arrays one after another, each value where it stands first."""
    return F.array_distinct(F.concat(*lists))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def page(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, int, int | None]:
    """(rows, total, next offset or None) of one page."""
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit), total, offset + limit if offset + limit < total else None


def ranked(df: DataFrame, score: str, key: str, origin: int = 1, by: list[str] | None = None) -> DataFrame:
    """Rank by score, ties by key, from ``origin`` on; of bounded lists, such as the top of a channel, or within ``by``."""
    window = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key)) if by else Window.orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(window) - (1 - origin))


def rrf(channels: list[tuple[DataFrame, float]], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists, each with its weight."""
    parts = None
    for n, (rows, w) in enumerate(channels):
        part = rows.select(key, F.lit(n).alias("channel"), (F.lit(w) / (F.lit(float(k)) + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key).agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("channel", "part"))), lambda s: s["part"]), F.lit(0.0), lambda a, x: a + x).alias("score"))


def best_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def unkeyed_too(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key in the order; rows without a key all stay."""
    rows = df.withColumn("_key", key)
    keyed = best_per_key(rows.where("_key is not null"), ["_key"], order)
    return keyed.unionByName(rows.where("_key is null")).drop("_key")


def ends_per_key(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The first n and the last n rows of each key."""
    up, down = (Window.partitionBy(*key).orderBy(o) for o in (F.asc(order), F.desc(order)))
    return df.withColumn("_a", F.row_number().over(up)).withColumn("_z", F.row_number().over(down)).where(f"_a <= {n} or _z <= {n}").drop("_a", "_z")


def capped_runs(df: DataFrame, key: list[str], order: str, in_run: Column, most: int) -> DataFrame:
    """Rows, in order, with at most ``most`` rows of a run in a row."""
    by = Window.partitionBy(*key).orderBy(order)
    rows = df.withColumn("_run", in_run).withColumn("_group", F.sum(F.when(F.col("_run"), 0).otherwise(1)).over(by))
    place = F.row_number().over(Window.partitionBy(*key, "_group", "_run").orderBy(order))
    return rows.withColumn("_place", place).where(~F.col("_run") | (F.col("_place") <= most)).drop("_run", "_group", "_place")


def within_budget(df: DataFrame, size: str, order: list, budget: int, key: str) -> DataFrame:
    """Per key the rows, in order, up to the one that would exceed the budget."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(run)).where(F.col("used") <= budget)


def order_statistics(counts: DataFrame, key: str, value: str, n: str, bins: int = 1024) -> DataFrame:
    """(key, n, median, p95, largest) by index in the ascending order of counts(key, value, n).

    Counts are first summed in bins over each key's range; only the bins in which
    an index falls are ordered by value, so no task orders a whole key unless one bin holds it.
    """
    ends = counts.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("largest"), F.sum(n).alias("total"))
    ends = ends.withColumn("wanted", F.array(F.floor(F.col("total") / 2), F.floor(F.col("total") * 0.95)))
    place = F.coalesce(F.floor((F.col(value) - F.col("low")) / F.nullif(F.col("largest") - F.col("low"), F.lit(0.0)) * bins), F.lit(0)).cast("int")
    dealt = counts.join(ends, key).withColumn("bin", place)
    before = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "bin", "wanted").agg(F.sum(n).alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0)))
    hit = sums.where(F.exists("wanted", lambda w: (w >= F.col("ahead")) & (w < F.col("ahead") + F.col("held")))).select(key, "bin", "ahead")
    inside = Window.partitionBy(key, "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(hit, [key, "bin"]).withColumn("upto", F.col("ahead") + F.sum(n).over(inside))
    at = lambda i: F.min(F.when(F.col("upto") > F.col("wanted")[i], F.col(value)))
    return rows.groupBy(key).agg(F.first("total").alias("n"), at(0).alias("median"), at(1).alias("p95"), F.first("largest").alias("largest"))


def containing(docs: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """(item_id, doc_id): documents(doc_id, text) that contain a passage(item_id, passage) whole.

    A passage may begin and end inside a word, but its second to fifth words stand whole in any text that has it: documents
    whose shingles hold those are found by a join on their hash, and the whole passage is compared only there.
    Passages too short for that are compared with every document, each block of them of a checked size.
    """
    split = lambda c: F.split(c, r"\s+")
    key = lambda ws, i: F.xxhash64(F.array_join(F.slice(ws, i, F.lit(words)), " "))
    items = passages.where("passage is not null").withColumn("ws", split(F.col("passage")))
    long = items.where(F.size("ws") >= words + 2).select("item_id", "passage", key(F.col("ws"), F.lit(2)).alias("key"))
    pieces = docs.select("doc_id", split(F.col("text")).alias("ws")).where(F.size("ws") >= words)
    pieces = pieces.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - (words - 1)), lambda i: key(F.col("ws"), i)))).alias("key"))
    near = pieces.join(long, "key").select("doc_id", "item_id", "passage").distinct()
    found = near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    short = items.where(F.size("ws") < words + 2).select("item_id", "passage")
    n, size = short.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()
    blocks = -(-max(n * 64, size) // (4 << 20))
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = found.unionByName(docs.join(F.broadcast(block), F.contains("text", "passage")).select("item_id", "doc_id"))
    return found
