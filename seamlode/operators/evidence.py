"""Evidence, comparability, agreement, contradiction, gap and practice operators over results.

results: experiment, material, document, value, kind, scale, basis, superseded, and where there are any
unit, sample_state, temperature_k and conditions (a map).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamlode.functions import numeric

# Trust in types of documents; any other has 0.6.
TRUST = {"catalog": 1.0, "handbook": 0.9, "internal_report": 0.8, "article": 0.7, "patent": 0.7}
SIGNATURE = ["kind", "scale", "basis", "dimension", "state", "temperature", "rest"]


def current(results: DataFrame) -> DataFrame:
    """Results that no later version replaces."""
    return results.where(~F.coalesce("superseded", F.lit(False))) if "superseded" in results.columns else results.where("superseded_by is null")


def filtered(results: DataFrame, equal: dict[str, object] | None = None, op: str | None = None, bound: float | None = None, year_from: int | None = None, unresolved: bool = False) -> DataFrame:
    """Results by optional conditions: columns equal to values, a bound on the value, a first year (of the result, else of its document).

    Each condition is one more conjunct; a name that could not be resolved gives no results.
    """
    if unresolved:
        return results.limit(0)
    for column, value in (equal or {}).items():
        results = results.where(F.col(column) == value)
    if op in ("<=", ">=") and bound is not None:
        value = F.coalesce(*(F.col(c) for c in ("nominal", "high", "low", "value") if c in results.columns))
        results = results.where(value <= bound if op == "<=" else value >= bound)
    if year_from:
        results = results.where(F.coalesce(*(F.col(c) for c in ("year", "document_year") if c in results.columns)) >= year_from)
    return results


def _or(df: DataFrame, column: str, kind: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def signed(results: DataFrame) -> DataFrame:
    """results with the seven parts by which they compare: kind, scale (none for null), basis, dimension of the unit, state, class of temperature, other conditions by name."""
    conditions = F.coalesce(_or(results, "conditions", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kelvin = F.coalesce(_or(results, "temperature_k", "double"), conditions["temperature_k"].try_cast("double"))
    rest = F.array_sort(F.map_entries(F.map_filter(conditions, lambda k, v: (k != "temperature_k") & v.isNotNull())))
    return results.withColumns({
        "scale": F.coalesce(_or(results, "scale", "string"), F.lit("none")), "basis": _or(results, "basis", "string"),
        "dimension": numeric.dimension(_or(results, "unit", "string")), "state": F.coalesce(_or(results, "sample_state", "string"), F.lit("")),
        "temperature": numeric.temperature_class(kelvin), "rest": rest,
    })


def gate(a: str, b: str) -> Column:
    """array: the axes on which two signed results, structs a and b, don't compare; empty if they do."""
    x, y = F.col(a), F.col(b)
    differ = lambda c: ~x[c].eqNullSafe(y[c])
    axes = [("quantity_kind", differ("kind")), ("scale", differ("scale")), ("basis", differ("basis")), ("unit_dim", differ("dimension")), ("processing_state", differ("state"))]
    axes.append(("measurement_conditions", differ("temperature") | differ("rest")))
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in axes)), lambda v: v.isNotNull())


def gate_pairs(results: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """(a, b, comparable, blocking) of pairs(a, b) of result ids; an id that isn't there blocks as not_found."""
    rows = signed(results)
    side = lambda name: rows.select(F.col(key).alias(name), F.struct(*SIGNATURE).alias(f"{name}_row"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    blocking = F.when(F.col("a_row").isNull() | F.col("b_row").isNull(), F.array(F.lit("not_found"))).otherwise(gate("a_row", "b_row"))
    return both.withColumn("blocking", blocking).select("a", "b", (F.size("blocking") == 0).alias("comparable"), "blocking")


def dispersion(low: Column, high: Column) -> Column:
    return F.when(high > 0, (high - low) / high).otherwise(0.0)


def spread_class(spread: Column) -> Column:
    return F.when(spread < 0.15, "consistent").when(spread < 0.5, "dispersed").otherwise("divergent")


def upper_median(value: str) -> Column:
    """The element at index n // 2 of the sorted values: the lower of two middles from above. Counts of different values are merged, no list is held."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")


def profile(results: DataFrame, key: str) -> DataFrame:
    """Per key the largest comparable group: envelope, upper median, dispersion, sources, and how many other groups there are; ties to the smaller signature."""
    rows = signed(results)
    groups = rows.groupBy(key, *SIGNATURE).agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), upper_median("value").alias("median"), F.count_distinct("document").alias("n_sources")
    )
    order = F.struct((-F.col("n")).alias("down"), *SIGNATURE)
    top = groups.groupBy(key).agg(F.min_by(F.struct(*(c for c in groups.columns if c != key)), order).alias("g"), (F.count("*") - 1).alias("other_groups"))
    return top.select(key, "g.*", "other_groups").withColumn("spread_class", F.when(F.col("n") == 1, "single").otherwise(spread_class(dispersion(F.col("low"), F.col("high")))))


def outliers(results: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Results of each key's largest group that lie over half of its median from it."""
    sides = [signed(results).alias("r"), profiles.select(key, *SIGNATURE, "median").alias("p")]
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (key, *SIGNATURE)]
    far = (F.col("median") != 0) & (F.abs(F.col("r.value") - F.col("median")) / F.abs("median") > 0.5)
    return sides[0].join(sides[1], reduce(lambda a, b: a & b, same)).where(far).select("r.*", "median")


def points(results: DataFrame) -> DataFrame:
    """Results from the most reliable: results(doc_type, confidence, document_year)."""
    return results.withColumn("reliability", reliability(F.col("doc_type"), F.col("confidence"), F.col("document_year"))).orderBy(F.desc("reliability"), "document", "value")


def agreement(results: DataFrame, key: str) -> DataFrame:
    """single, incomparable (more than one signature, nulls being values), contradictory (spread over 0.3) or consistent."""
    facts = signed(results).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*SIGNATURE)).alias("signatures"), F.min("value").alias("low"), F.max("value").alias("high"))
    flag = F.when(F.col("n") == 1, "single").when(F.col("signatures") > 1, "incomparable").when(dispersion(F.col("low"), F.col("high")) > 0.3, "contradictory").otherwise("consistent")
    return facts.select(key, "n", flag.alias("flag"))


def reliability(doc_type: Column, confidence: Column, year: Column) -> Column:
    """Trust in the type by confidence (0.7 for none) by recency, plus 0.3, 1 at most, to two places."""
    recency = F.when(year >= 2020, 1.0).when(year >= 2010, 0.95).otherwise(0.9)
    trust = F.coalesce(numeric.lookup(TRUST, doc_type), F.lit(0.6))
    return F.round(F.least(F.lit(1.0), trust * F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.7)) * recency + 0.3), 2)


def severity(delta: Column, a: Column, b: Column) -> Column:
    """high: over 0.5 apart and both reliable (0.7); medium: both over 0.6; else low."""
    least = F.least(a, b)
    return F.when((delta > 0.5) & (least > 0.7), "high").when(least > 0.6, "medium").otherwise("low")


def contradictions(results: DataFrame, threshold: float) -> DataFrame:
    """Comparable pairs of different documents whose values differ by more than the threshold.

    An equi-join on the null-safe comparability key, of keys with more than one value only; null documents count as the same.
    """
    rows = signed(results)
    key = ["material", *SIGNATURE]
    apart = rows.groupBy(*key).agg(F.min("value").alias("low"), F.max("value").alias("high")).where((F.col("high") > 0) & ((F.col("high") - F.col("low")) / F.col("high") > threshold))
    same = lambda x, y: reduce(lambda a, b: a & b, (F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in key))
    rows = rows.alias("r").join(apart.alias("k"), same("r", "k"), "left_semi")
    a, b = (rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns]) for side in "ab")
    on = reduce(lambda x, y: x & y, (F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in key))
    first, second = (F.struct(*(f"{s}_{c}" for c in ("document", "experiment", "value"))) for s in "ab")
    high = F.greatest("a_value", "b_value")
    delta = F.abs(F.col("a_value") - F.col("b_value")) / high
    return a.join(b, on).where(first < second).where(~F.col("a_document").eqNullSafe(F.col("b_document")) & (high > 0) & (delta > threshold)).withColumn("delta", delta)


def grid_gaps(facts: DataFrame, rows: str, cols: str) -> DataFrame:
    """Cells of the grid of both dimensions without a fact, with the facts of their row. The grid has as many cells as the answer may have."""
    totals = facts.groupBy(rows).agg(F.count("*").alias("weight"))
    grid = totals.crossJoin(facts.select(cols).distinct())
    return grid.join(facts.select(rows, cols).distinct(), [rows, cols], "left_anti")


def grid_counts(facts: DataFrame, dimensions: list[str]) -> DataFrame:
    """Facts in every cell of the grid of the dimensions' values, 0 where there are none; facts that lack one are left out."""
    there = facts.where(reduce(lambda a, b: a & b, (F.col(d).isNotNull() for d in dimensions)))
    grid = reduce(lambda g, d: g.crossJoin(there.select(d).distinct()), dimensions[1:], there.select(dimensions[0]).distinct())
    return grid.join(there.groupBy(*dimensions).agg(F.count("*").alias("n")), dimensions, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def gap_summary(materials: DataFrame, kinds: DataFrame, results: DataFrame, always: list[str]) -> DataFrame:
    """(material, kind): cells without a result, of kinds that are measured somewhere or always wanted."""
    wanted = kinds.join(results.select("kind").distinct().withColumn("seen", F.lit(True)), "kind", "left").where(F.col("seen") | F.col("kind").isin(always)).select("kind")
    return materials.select("material").distinct().crossJoin(wanted).join(results.select("material", "kind").distinct(), ["material", "kind"], "left_anti")


def practice(facts: DataFrame, key: str, country: str, document: str, home: str) -> DataFrame:
    """Distinct documents at home, abroad and in all; which side alone has any."""
    home_docs = F.count_distinct(F.when(F.col(country) == home, F.col(document)))
    abroad = F.count_distinct(F.when(F.col(country) != home, F.col(document)))
    out = facts.groupBy(key).agg(home_docs.alias("domestic"), abroad.alias("foreign_docs"), F.count_distinct(document).alias("all_docs"))
    only = F.when(F.col("foreign_docs") == 0, "domestic").when(F.col("domestic") == 0, "foreign")
    return out.withColumn("exclusive", F.coalesce(only, F.lit("both")))


def directions_conflict(claims: DataFrame, key: list[str]) -> DataFrame:
    """Keys that claims say both increase and decrease."""
    dirs = claims.groupBy(*key).agg(F.collect_set("direction").alias("dirs"), F.count("*").alias("n"))
    return dirs.where(F.array_contains("dirs", "increases") & F.array_contains("dirs", "decreases")).drop("dirs")


def documents_by(rows: DataFrame, key: str, document: str, most: int = 10) -> DataFrame:
    """Of each value of a key the number of its documents and the first of them by name; nulls are left out."""
    there = rows.where(F.col(key).isNotNull() & F.col(document).isNotNull()).select(key, document).distinct()
    order = Window.partitionBy(key).orderBy(document)
    first = there.withColumn("r", F.row_number().over(order)).groupBy(key).agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col(document)))).alias("docs"))
    return first


def worst_status(stages: DataFrame, key: str, rank: dict[str, int]) -> DataFrame:
    """The status of least rank of each key."""
    return stages.groupBy(key).agg(F.min_by("status", numeric.lookup(rank, F.col("status"))).alias("status"))


def validated(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): rejects have the names of the rules that they break; a rule that can't be told is broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    marked = rows.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def grounded(claims: DataFrame, pool: DataFrame, most: int = 6) -> DataFrame:
    """claims(claim_id, text, confidence, refs array) with the refs of pool(ref, source) that are there; without any the confidence is low. The first ``most``."""
    rows = claims.orderBy("claim_id").limit(most)
    refs = rows.select("claim_id", F.posexplode("refs").alias("at", "ref")).join(pool, "ref")
    found = refs.groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("sources"))
    out = rows.drop("refs").join(found, "claim_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("confidence", F.when(F.col("sources").isNull(), "low").otherwise(F.col("confidence"))).withColumn("sources", F.coalesce("sources", none))
