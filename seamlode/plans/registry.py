"""Queries of the reference's own operators, with the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamlode.functions import numeric, text
from seamlode.operators import evidence, graph, quality, retrieval, search
from seamlode.sources.tables import table
from seamlode.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang, source")
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters per language and source."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


# -- the model over the tables: results, facts with country and year, edges -------------

_RESULTS = """SELECT l_orderkey AS experiment, l_partkey AS material, l_suppkey AS document, l_extendedprice AS value,
  CAST(l_linenumber % 3 AS INTEGER) AS kind, l_linestatus AS scale, l_returnflag AS basis, l_discount >= 0.095 AS superseded FROM lineitem"""
_FACTS = f"""SELECT r.*, CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_orderpriority AS process, o.o_custkey AS lab, p.p_brand AS family, p.p_type AS grade, p.p_size AS size, n.n_name AS country
  FROM ({_RESULTS}) r JOIN orders o ON r.experiment = o.o_orderkey LEFT JOIN part p ON r.material = p.p_partkey
  LEFT JOIN supplier s ON r.document = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey"""
_EDGES = """SELECT concat('o', CAST(o_orderkey AS VARCHAR)) AS src, concat('c', CAST(o_custkey AS VARCHAR)) AS dst, 'ordered_by' AS predicate FROM orders
  UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR)), concat('n', CAST(c_nationkey AS VARCHAR)), 'located_in' FROM customer
  UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR)), concat('r', CAST(n_regionkey AS VARCHAR)), 'part_of' FROM nation
  UNION ALL SELECT concat('o', CAST(l_orderkey AS VARCHAR)), concat('p', CAST(l_partkey AS VARCHAR)), 'uses' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l"""
HOME = "NATION_3"


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("experiment"), F.col("l_partkey").alias("material"), F.col("l_suppkey").alias("document"), F.col("l_extendedprice").alias("value"),
        (F.col("l_linenumber") % 3).cast("int").alias("kind"), F.col("l_linestatus").alias("scale"), F.col("l_returnflag").alias("basis"), (F.col("l_discount") >= 0.095).alias("superseded"),
    )


def facts(spark: SparkSession, d: str) -> DataFrame:
    t = lambda name: table(spark, d, name)
    rows = results(spark, d).join(t("orders"), F.col("experiment") == F.col("o_orderkey"))
    rows = rows.join(t("part"), F.col("material") == F.col("p_partkey"), "left").join(t("supplier"), F.col("document") == F.col("s_suppkey"), "left")
    rows = rows.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(
        "experiment", "material", "document", "value", "kind", "scale", "basis", "superseded", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("process"),
        F.col("o_custkey").alias("lab"), F.col("p_brand").alias("family"), F.col("p_type").alias("grade"), F.col("p_size").alias("size"), F.col("n_name").alias("country"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    parts = [("orders", "o", "o_orderkey", "c", "o_custkey", "ordered_by"), ("customer", "c", "c_custkey", "n", "c_nationkey", "located_in"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "part_of"), ("lineitem", "o", "l_orderkey", "p", "l_partkey", "uses")]
    out = None
    for name, a, src, b, dst, predicate in parts:
        rows = table(spark, d, name).select(named(a, src).alias("src"), named(b, dst).alias("dst"), F.lit(predicate).alias("predicate"))
        rows = rows.distinct() if name == "lineitem" else rows
        out = rows if out is None else out.unionByName(rows)
    return out


# -- evidence ---------------------------------------------------------------------------

@query(f"SELECT experiment, material, document, value, kind, scale, basis, year, country FROM ({_FACTS}) WHERE NOT superseded AND process = '1-URGENT' AND value <= 20000 AND year >= 1995 AND country = '{HOME}'")
def evidence_rows(spark, d):
    """Current results of a process with a bound on value and year, in one country."""
    rows = evidence.current(facts(spark, d)).where((F.col("process") == "1-URGENT") & (F.col("value") <= 20000) & (F.col("year") >= 1995) & (F.col("country") == HOME))
    return rows.select("experiment", "material", "document", "value", "kind", "scale", "basis", "year", "country")


@query(f"SELECT material, count(DISTINCT experiment) AS n_experiments, count(DISTINCT document) AS n_documents, array_to_string(list_sort(list(DISTINCT country)), ',') AS countries, CASE WHEN count(DISTINCT document) > 1 THEN 'high' ELSE 'low' END AS confidence FROM ({_FACTS}) WHERE NOT superseded GROUP BY material")
def evidence_summary(spark, d):
    """Experiments, documents, countries and confidence of each material."""
    rows = evidence.current(facts(spark, d)).groupBy("material")
    return rows.agg(F.count_distinct("experiment").alias("n_experiments"), F.count_distinct("document").alias("n_documents"), F.array_join(F.sort_array(F.collect_set("country")), ",").alias("countries"), F.when(F.count_distinct("document") > 1, "high").otherwise("low").alias("confidence"))


_PROFILE = """WITH g AS (SELECT material, kind, scale, basis, count(*) AS n, min(value) AS low, max(value) AS high, list_sort(list(value))[CAST(count(*) // 2 AS BIGINT) + 1] AS median FROM ({R}) WHERE NOT superseded GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY material ORDER BY n DESC, kind, scale, basis) AS r FROM g)
  SELECT material, kind, scale, basis, n, low, high, median, CASE WHEN n = 1 THEN 'single' WHEN (high - low) / high < 0.15 THEN 'consistent' WHEN (high - low) / high < 0.5 THEN 'dispersed' ELSE 'divergent' END AS spread_class FROM t WHERE r = 1"""


@query(_PROFILE.format(R=_RESULTS))
def evidence_profile(spark, d):
    """Envelope, upper median and dispersion of the largest comparable group of each material."""
    found = evidence.profile(evidence.current(results(spark, d)), "material")
    return found.select("material", "kind", "scale", "basis", "n", "low", "high", "median", "spread_class")


@query(f"SELECT material, count(*) AS n, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT (kind, scale, basis)) > 1 THEN 'incomparable' WHEN (max(value) - min(value)) / max(value) > 0.3 THEN 'contradictory' ELSE 'consistent' END AS flag FROM ({_RESULTS}) WHERE NOT superseded GROUP BY material")
def agreement_flag(spark, d):
    """Whether the results of a material agree."""
    return evidence.agreement(evidence.current(results(spark, d)), "material")


@query(f"""WITH r AS (SELECT * FROM ({_RESULTS}) WHERE NOT superseded) SELECT a.material, a.kind, count(*) AS n_pairs, max(abs(a.value - b.value) / greatest(a.value, b.value)) AS largest
  FROM r a JOIN r b ON a.material = b.material AND a.kind = b.kind AND a.scale = b.scale AND a.basis = b.basis AND (a.document, a.experiment, a.value) < (b.document, b.experiment, b.value) AND a.document <> b.document
  WHERE abs(a.value - b.value) / greatest(a.value, b.value) > 0.3 GROUP BY a.material, a.kind""")
def contradictions_measure(spark, d):
    """Comparable pairs of different documents that differ by over 30 per cent, per material and kind."""
    pairs = evidence.contradictions(evidence.current(results(spark, d)), 0.3)
    return pairs.groupBy(F.col("a_material").alias("material"), F.col("a_kind").alias("kind")).agg(F.count("*").alias("n_pairs"), F.max("delta").alias("largest"))


@query(f"""WITH y AS (SELECT process, family, year, count(*) AS n FROM ({_FACTS}) GROUP BY ALL), c AS (SELECT process, family, CASE WHEN n > lag(n) OVER w THEN 'increases' WHEN n < lag(n) OVER w THEN 'decreases' END AS direction FROM y WINDOW w AS (PARTITION BY process, family ORDER BY year))
  SELECT process, family, count(*) AS n FROM c WHERE direction IS NOT NULL GROUP BY ALL HAVING count(DISTINCT direction) = 2""")
def contradictions_claim(spark, d):
    """Process and family whose yearly claims go both ways."""
    yearly = facts(spark, d).groupBy("process", "family", "year").agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("process", "family").orderBy("year"))
    claims = yearly.withColumn("direction", F.when(F.col("n") > before, "increases").when(F.col("n") < before, "decreases")).where("direction is not null")
    return evidence.directions_conflict(claims, ["process", "family"])


_TYPES = ["catalog", "handbook", "internal_report", "article", "patent", "memo"]


@query(f"""SELECT experiment, document, value, CAST(floor(round(least(1.0, t * c * r + 0.3), 2) * 100 + 0.5) AS BIGINT) AS reliability_pct FROM (SELECT *, CASE document % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 5 THEN 0.6 ELSE 0.7 END::DOUBLE AS t,
  CASE kind WHEN 0 THEN 0.7 WHEN 1 THEN 0.83 ELSE 0.91 END::DOUBLE AS c, CASE WHEN year + 20 >= 2020 THEN 1.0 WHEN year + 20 >= 2010 THEN 0.95 ELSE 0.9 END::DOUBLE AS r FROM ({_FACTS}))""")
def reliability(spark, d):
    """Trust in the type of document by confidence by recency, plus 0.3, at most 1; types and confidences stand for suppliers and kinds, and no confidence for 0.7."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("document") % 6 + 1).cast("int"))
    confidence = F.when(F.col("kind") == 1, 0.83).when(F.col("kind") == 2, 0.91)
    score = evidence.reliability(kind, confidence, F.col("year") + 20)
    return facts(spark, d).select("experiment", "document", "value", F.floor(score * 100 + 0.5).cast("long").alias("reliability_pct"))


@query(f"SELECT g.material, k.process, g.weight FROM (SELECT material, count(*) AS weight FROM ({_FACTS}) WHERE value > 80000 GROUP BY material) g CROSS JOIN (SELECT DISTINCT process FROM ({_FACTS}) WHERE value > 80000) k WHERE NOT EXISTS (SELECT 1 FROM ({_FACTS}) f WHERE f.value > 80000 AND f.material = g.material AND f.process = k.process)")
def gaps_empty_cells(spark, d):
    """Cells of material and process without a result above a value."""
    return evidence.grid_gaps(facts(spark, d).where("value > 80000").select("material", "process"), "material", "process")


@query(f"SELECT b.family, t.grade, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_brand AS family FROM part) b CROSS JOIN (SELECT DISTINCT p_type AS grade FROM part) t LEFT JOIN (SELECT family, grade, count(*) AS n FROM ({_FACTS}) GROUP BY ALL) f ON f.family = b.family AND f.grade = t.grade")
def coverage_grid(spark, d):
    """Results for every family and grade, 0 where there are none."""
    parts = table(spark, d, "part")
    grid = parts.select(F.col("p_brand").alias("family")).distinct().crossJoin(parts.select(F.col("p_type").alias("grade")).distinct())
    return grid.join(facts(spark, d).groupBy("family", "grade").agg(F.count("*").alias("n")), ["family", "grade"], "left").select("family", "grade", F.coalesce("n", F.lit(0)).alias("n"))


_PRACTICE = f"SELECT grade, count(DISTINCT CASE WHEN country = '{HOME}' THEN document END) AS domestic, count(DISTINCT CASE WHEN country <> '{HOME}' THEN document END) AS foreign_docs, count(DISTINCT document) AS all_docs FROM ({_FACTS}) GROUP BY grade"


@query(f"SELECT *, CASE WHEN foreign_docs = 0 THEN 'domestic' WHEN domestic = 0 THEN 'foreign' ELSE 'both' END AS exclusive FROM ({_PRACTICE})")
def compare_practice(spark, d):
    """Documents at home and abroad for each grade, and grades known on one side only."""
    return evidence.practice(facts(spark, d), "grade", "country", "document", HOME)


@query(f"SELECT material, count(DISTINCT document) AS n_sources FROM ({_FACTS}) GROUP BY material HAVING count(DISTINCT document) < 20")
def gaps_low_coverage(spark, d):
    """Materials with few sources."""
    return facts(spark, d).groupBy("material").agg(F.count_distinct("document").alias("n_sources")).where("n_sources < 20")


@query(f"""SELECT topic, topic_type, count(*) AS n_reasons, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (
  SELECT process AS topic, 'process' AS topic_type, 'many superseded' AS reason FROM ({_FACTS}) GROUP BY process HAVING count(CASE WHEN superseded THEN 1 END) * 25 > count(*)
  UNION ALL SELECT process, 'process', 'high value' FROM ({_FACTS}) GROUP BY process HAVING max(value) > 100000
  UNION ALL SELECT CAST(kind AS VARCHAR), 'kind', 'high value' FROM ({_FACTS}) GROUP BY kind HAVING max(value) > 100000) GROUP BY ALL""")
def risk_zones(spark, d):
    """Topics with the reasons from three sources."""
    rows = facts(spark, d)
    one = rows.groupBy(F.col("process").alias("topic")).agg((F.count(F.when(F.col("superseded"), 1)) * 25 > F.count("*")).alias("a"), (F.max("value") > 100000).alias("b"))
    found = one.where("a").select("topic", F.lit("process").alias("topic_type"), F.lit("many superseded").alias("reason")).unionByName(one.where("b").select("topic", F.lit("process").alias("topic_type"), F.lit("high value").alias("reason")))
    kinds = rows.groupBy(F.col("kind").cast("string").alias("topic")).agg(F.max("value").alias("m")).where("m > 100000")
    found = found.unionByName(kinds.select("topic", F.lit("kind").alias("topic_type"), F.lit("high value").alias("reason")))
    return found.groupBy("topic", "topic_type").agg(F.count("*").alias("n_reasons"), F.array_join(F.sort_array(F.collect_list("reason")), ",").alias("reasons"))


@query(f"SELECT process, min(value) AS low, max(value) AS high, count(DISTINCT experiment) AS n_experiments FROM ({_FACTS}) WHERE NOT superseded GROUP BY process")
def compare_technologies(spark, d):
    """Envelope of the current values of each process."""
    return evidence.current(facts(spark, d)).groupBy("process").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("experiment").alias("n_experiments"))


@query(f"WITH c AS (SELECT c.c_mktsegment AS topic, c.c_custkey AS lab, count(DISTINCT f.experiment) AS n FROM ({_FACTS}) f JOIN customer c ON c.c_custkey = f.lab GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, lab) AS rank FROM c) SELECT topic, lab, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def experts_by_topic(spark, d):
    """The five labs with most experiments on each topic."""
    labs = table(spark, d, "customer").select(F.col("c_custkey").alias("lab"), F.col("c_mktsegment").alias("topic"))
    n = facts(spark, d).join(labs, "lab").groupBy("topic", "lab").agg(F.count_distinct("experiment").alias("n"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "lab"))
    return n.withColumn("rank", rank).where("rank <= 5")


@query("SELECT o_orderkey AS experiment, o_orderdate AS at, o_orderstatus AS status FROM orders ORDER BY o_orderdate ASC NULLS LAST, o_orderkey LIMIT 200")
def timeline(spark, d):
    """The first 200 experiments by date, undated last."""
    return table(spark, d, "orders").orderBy(F.asc_nulls_last("o_orderdate"), "o_orderkey").limit(200).select(F.col("o_orderkey").alias("experiment"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"))


@query(f"SELECT kind, basis, count(DISTINCT document) AS n_documents, count(*) AS n FROM ({_RESULTS}) GROUP BY ALL HAVING count(*) >= 2")
def consensus(spark, d):
    """Kind and basis backed by two or more results."""
    return results(spark, d).groupBy("kind", "basis").agg(F.count_distinct("document").alias("n_documents"), F.count("*").alias("n")).where("n >= 2")


@query(f"SELECT * FROM ({_FACTS})")
def flat_view(spark, d):
    """The flat search view: results with all their dimensions."""
    return facts(spark, d)


@query(f"SELECT experiment, material, document, value FROM ({_FACTS}) WHERE (family ILIKE '%1%' OR grade ILIKE '%e%') AND value BETWEEN 1000 AND 90000 AND process IN ('1-URGENT', '2-HIGH') ORDER BY value DESC, experiment, material, document LIMIT 50 OFFSET 100")
def flat_search_page(spark, d):
    """One page of a filtered search of the flat view."""
    rows = facts(spark, d).where((F.col("family").ilike("%1%") | F.col("grade").ilike("%e%")) & F.col("value").between(1000, 90000) & F.col("process").isin("1-URGENT", "2-HIGH"))
    return rows.orderBy(F.desc("value"), "experiment", "material", "document").offset(100).limit(50).select("experiment", "material", "document", "value")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') ORDER BY lower(p_name) = 'bolt' DESC, length(p_name), p_name, p_partkey LIMIT 1")
def alias_resolve(spark, d):
    """A name's entity: the exact alias, else the shortest that contains the text."""
    names = table(spark, d, "part").select(F.col("p_name").alias("alias"), F.col("p_partkey").alias("name"))
    return search.alias_resolve(names, "bolt").select(F.col("name").alias("p_partkey"), F.col("alias").alias("p_name"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'linked_documents', count(DISTINCT l_suppkey) FROM lineitem")
def corpus_counters(spark, d):
    """Sizes of the corpus."""
    t = lambda name: table(spark, d, name)
    out = t("lineitem").agg(F.count_distinct("l_suppkey").alias("n")).select(F.lit("linked_documents").alias("name"), "n")
    for name in ("orders", "part", "documents"):
        out = out.unionByName(t(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


# -- graph ------------------------------------------------------------------------------

@query(f"SELECT src, dst, predicate FROM ({_EDGES})")
def edges_view(spark, d):
    """All edges as one relation."""
    return edges(spark, d)


@query(f"SELECT predicate, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM ({_EDGES}) GROUP BY predicate")
def predicate_histogram(spark, d):
    """Edges of each predicate."""
    return edges(spark, d).groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


@query(f"""WITH e AS (SELECT src, dst FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})), one AS (SELECT DISTINCT dst AS node FROM e WHERE src = 'r1'),
  two AS (SELECT DISTINCT e.dst AS node FROM e JOIN one ON e.src = one.node WHERE e.dst <> 'r1' AND e.dst NOT IN (SELECT node FROM one))
  SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two""")
def neighbourhood_2hop(spark, d):
    """Nodes within two undirected steps of a region."""
    return graph.neighbourhood(edges(spark, d), spark.range(1).select(F.lit("r1").alias("node")), 2)


@query("SELECT concat('o', CAST(o_orderkey AS VARCHAR)) AS node FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def isolated_nodes(spark, d):
    """Experiments that use no material."""
    nodes = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.isolated(nodes, edges(spark, d).where("predicate = 'uses'"))


_STEPS = "SELECT l_orderkey AS o, l_linenumber AS a, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) t"


@query(f"""WITH RECURSIVE s AS (SELECT concat(CAST(o AS VARCHAR), '-', CAST(a AS VARCHAR)) AS src, concat(CAST(o AS VARCHAR), '-', CAST(b AS VARCHAR)) AS dst FROM ({_STEPS}) WHERE b IS NOT NULL),
  l AS (SELECT src AS root, src AS node, 0 AS depth FROM s UNION ALL SELECT l.root, s.dst, l.depth + 1 FROM l JOIN s ON l.node = s.src WHERE l.depth < 11) SELECT root, node, depth FROM l""")
def lineage(spark, d):
    """Chains of derived steps, below depth 12."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    name = lambda c: F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col(c).cast("string"))
    steps = lines.withColumn("b", F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).where("b is not null").select(name("l_linenumber").alias("src"), name("b").alias("dst"))
    return graph.lineage(steps, steps.select(F.col("src").alias("root")))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey <= 100000000")
def upsert_new(spark, d):
    """Loading all customers over half of them: each is there once."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return graph.upsert_new(rows.where("c_nationkey < 12"), rows.unionByName(rows), ["c_custkey"])


# -- retrieval --------------------------------------------------------------------------

_TERMS = r"[x FOR x IN string_split_regex(lower(text), '[^\p{L}\p{N}]+') IF x <> '']"
_WORDS = ["license", "mit", "apache", "public"]
_POSTS = f"SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len({_TERMS}) AS size, unnest({_TERMS}) AS term FROM documents) WHERE term IN ('license', 'mit', 'apache', 'public') GROUP BY ALL"


@query(f"SELECT term, count(DISTINCT doc_id) AS df, CAST(floor(ln(1 + ((SELECT count(*) FROM documents) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)) * 1e6 + 0.5) AS BIGINT) AS idf_e6 FROM ({_POSTS}) GROUP BY term")
def idf(spark, d):
    """Document frequency and inverse document frequency of query terms."""
    docs = table(spark, d, "documents")
    found = retrieval.idf(retrieval.postings(docs, _WORDS), docs.agg(F.count("*").alias("n")))
    return found.select("term", "df", F.floor(F.col("idf") * 1e6 + 0.5).cast("long").alias("idf_e6"))


_BM25 = f"""WITH p AS ({_POSTS}), t AS (SELECT count(*) AS n, sum(len({_TERMS})) / count(*) AS mean FROM documents), w AS (SELECT term, ln(1 + ((SELECT n FROM t) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)) AS idf FROM p GROUP BY term)
  SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM p JOIN w USING (term) CROSS JOIN t GROUP BY doc_id"""


@query(f"SELECT doc_id, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_e6 FROM ({_BM25})")
def content_bm25(spark, d):
    """BM25 of every document that has a term of the query."""
    found = retrieval.bm25(table(spark, d, "documents"), _WORDS)
    return found.select("doc_id", F.floor(F.col("score") * 1e6 + 0.5).cast("long").alias("score_e6"))


_DOT = "list_inner_product([floor(256 * CAST(x AS DOUBLE)) FOR x IN e.embedding], [floor(256 * CAST(x AS DOUBLE)) FOR x IN q.embedding])"


@query(f"SELECT e.vec_id, CAST({_DOT} AS BIGINT) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def dense_knn(spark, d):
    """The ten vectors nearest to one by inner product, exactly."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    one = rows.where("vec_id = 0").select(F.col("v").alias("q"))
    score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    found = rows.where("vec_id <> 0").crossJoin(one).select("vec_id", score.alias("score"))
    return retrieval.top(found, "score", "vec_id", 10)


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' ORDER BY rank LIMIT 100), b AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) - length(replace(text, 'the', '')) DESC, doc_id) AS rank FROM documents WHERE lang = 'en' ORDER BY rank LIMIT 100)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(floor((coalesce(1.0 / (60.0 + a.rank), 0.0) + coalesce(1.0 / (60.0 + b.rank), 0.0)) * 1e9 + 0.5) AS BIGINT) AS score_e9 FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def rrf_fusion(spark, d):
    """Two ranked lists of documents fused by reciprocal ranks."""
    docs = table(spark, d, "documents").where("lang = 'en'")
    uses = docs.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))).alias("s"))
    channels = [(retrieval.ranked(retrieval.top(x, "s", "doc_id", 100), "s", "doc_id"), 1.0) for x in (docs.select("doc_id", F.col("n_chars").alias("s")), uses)]
    return retrieval.rrf(channels, "doc_id").select("doc_id", F.floor(F.col("score") * 1e9 + 0.5).cast("long").alias("score_e9"))


@query("SELECT c_custkey, c_name, CAST(levenshtein(c_name, 'Customer#000000123') AS INTEGER) AS distance FROM customer WHERE levenshtein(c_name, 'Customer#000000123') <= 2")
def fuzzy_match(spark, d):
    """Names within two edits of a query."""
    distance = F.levenshtein("c_name", F.lit("Customer#000000123"))
    return table(spark, d, "customer").select("c_custkey", "c_name", distance.alias("distance")).where("distance <= 2")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, left(text, 60) ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT doc_id, source, n_chars FROM r WHERE r = 1")
def first_per_key(spark, d):
    """The longest document of each source and opening of 60 characters."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", text.excerpt(F.col("text"), 60).alias("opening"))
    return retrieval.best_per_key(rows, ["source", "opening"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, source, used FROM (SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= 50000")
def running_budget(spark, d):
    """Documents of each source up to a budget of characters."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return retrieval.within_budget(rows, "n_chars", [F.desc("n_chars"), F.asc("doc_id")], 50000, "source").select("doc_id", "source", "used")


# -- text -------------------------------------------------------------------------------

@query("SELECT doc_id, CAST(k AS INTEGER) AS chunk, substring(text, CAST(k * 400 + 1 AS BIGINT), 500) AS piece FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 100) / 400.0) AS BIGINT), 1))) AS k FROM documents)")
def chunk_fixed(spark, d):
    """Chunks of 500 characters that overlap by 100."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.col("text"), 500, 100)).alias("chunk", "piece"))


@query("SELECT doc_id, CAST(floor(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) * 10000.0 / nullif(length(text), 0)) AS BIGINT) AS share_e4 FROM documents")
def language_share(spark, d):
    """Share of ASCII letters in each document."""
    return table(spark, d, "documents").select("doc_id", F.floor(F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) * 10000.0 / F.nullif(F.length("text"), F.lit(0))).cast("long").alias("share_e4"))


@query("SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(spark, d):
    """Lines that stand in three documents or more."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_documents")).where("n_documents >= 3")


@query("SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS cleaned FROM (SELECT doc_id, i, line, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE before IS NULL OR trim(line, ' ') = '' OR trim(line, ' ') <> trim(before, ' ') GROUP BY doc_id")
def cleanup_lines(spark, d):
    """Documents without a line that repeats the one before."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.clean_lines(F.split("text", "\n")), "\n").alias("cleaned"))


@query("""SELECT term, reason FROM (SELECT term, CASE WHEN trim(term) = '' THEN 'empty' WHEN regexp_matches(term, '[‘’“”«»]') THEN 'smart_quote_fragment' WHEN regexp_matches(trim(term), '^[A-Z][a-zA-Z]+-[A-Z0-9]{1,3}$') THEN 'brand_code'
  WHEN length(trim(term)) = 1 THEN 'single_char' WHEN length(trim(term)) <= 2 THEN 'bare_short_token' WHEN lower(trim(term)) IN ('extraction', 'process', 'method', 'material', 'production', 'solution', 'recovery', 'product', 'system', 'unit', 'plant') THEN 'generic_english' END AS reason
  FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS term FROM benchmark)) WHERE reason IS NOT NULL""")
def junk_terms(spark, d):
    """Terms that are no entities, with the reason."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).distinct()
    return words.select("term", text.junk_reason(F.col("term")).alias("reason")).where("reason is not null")


# -- events, sets, scoring --------------------------------------------------------------

@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def fixed_window_counter(spark, d):
    """Events of each type in each hour; ``streaming.windows`` keeps the same on a stream."""
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT CAST(ts AS DATE) AS day, least(count(*), 100) AS used, count(*) > 100 AS capped FROM events WHERE event_type = 'view' GROUP BY ALL")
def daily_cap(spark, d):
    """Daily use of a capped resource."""
    rows = table(spark, d, "events").where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return rows.select("day", F.least("n", F.lit(100)).cast("long").alias("used"), (F.col("n") > 100).alias("capped"))


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(v) AS n, v[len(v) // 2 + 1] AS median, v[CAST(floor(0.95 * len(v)) AS BIGINT) + 1] AS p95, v[len(v)] AS largest FROM s")
def run_aggregation(spark, d):
    """Count, median, 95th percentile by index and largest value of each type."""
    counts = table(spark, d, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    return retrieval.order_statistics(counts, "event_type", "value", "n")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type, max(event_id) AS last_id FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    """The latest event of each user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("event_id").alias("last_id"))


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c) SELECT source, lang, n FROM r WHERE r = 1")
def majority_vote(spark, d):
    """The commonest language of each source."""
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return retrieval.best_per_key(n, ["source"], [F.desc("n"), F.asc("lang")])


@query("(SELECT l_suppkey AS k FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION (SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem)")
def set_operations(spark, d):
    """Intersection, difference and distinct union of key sets."""
    used, all_ = table(spark, d, "lineitem"), table(spark, d, "supplier")
    both = used.where("l_linenumber = 1").select(F.col("l_suppkey").alias("k")).intersect(all_.where("s_acctbal > 0").select("s_suppkey"))
    return both.union(all_.select("s_suppkey").exceptAll(used.select("l_suppkey").distinct())).distinct()


@query("SELECT b.item_id, count(*) AS n_documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def gold_containment(spark, d):
    """Documents that contain a benchmark passage whole."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    found = retrieval.containing(table(spark, d, "documents").select("doc_id", "text"), items)
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"))


@query("SELECT quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS n_toxic, CAST(floor(sum(toxic) * 10000.0 / count(*)) AS BIGINT) AS share_e4 FROM labels GROUP BY quality")
def score_by_category(spark, d):
    """Share of a mark in each category."""
    return table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"), F.floor(F.sum("toxic") * 10000.0 / F.count("*")).cast("long").alias("share_e4"))


# -- values, units, scores, gates ---------------------------------------------------------


_NUM = r"([-+]?\d+(?:[.,]\d+)?)"
_WRITTEN = """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN concat('about ', s, ',5') WHEN 1 THEN concat('d = ', s, ' ± 2 mm') WHEN 2 THEN concat(p_size + 9, '–', s) WHEN 3 THEN concat('≤ ', s) WHEN 4 THEN concat('не менее ', s)
  WHEN 5 THEN concat('from ', s, '…', p_size + 3, ' K') ELSE 'none given' END AS t FROM (SELECT p_partkey, p_size, CAST(p_size AS VARCHAR) AS s FROM part)"""


def _found(pattern: str, group: int) -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract(t, '{pattern}', {group}), ''), ',', '.') AS DOUBLE)"


_SPREAD_SQL, _SPAN_SQL, _MOST_SQL, _LEAST_SQL = rf"{_NUM}\s*±\s*{_NUM}", rf"{_NUM}\s*[–\-−…]\s*{_NUM}", rf"[≤<]\s*=?\s*{_NUM}", rf"(?:[≥>]\s*=?|более|не менее|свыше)\s*{_NUM}"


@query(f"""SELECT p_partkey, CASE k WHEN 'span' THEN least({_found(_SPAN_SQL, 1)}, {_found(_SPAN_SQL, 2)}) WHEN 'least' THEN {_found(_LEAST_SQL, 1)} END AS low, CASE k WHEN 'spread' THEN {_found(_SPREAD_SQL, 1)} WHEN 'plain' THEN {_found(_NUM, 1)} END AS nominal,
  CASE k WHEN 'span' THEN greatest({_found(_SPAN_SQL, 1)}, {_found(_SPAN_SQL, 2)}) WHEN 'most' THEN {_found(_MOST_SQL, 1)} END AS high, CASE k WHEN 'spread' THEN {_found(_SPREAD_SQL, 2)} END AS deviation
  FROM (SELECT *, CASE WHEN regexp_matches(t, '{_SPREAD_SQL}') THEN 'spread' WHEN regexp_matches(t, '{_SPAN_SQL}') THEN 'span' WHEN regexp_matches(t, '{_MOST_SQL}') THEN 'most' WHEN regexp_matches(t, '{_LEAST_SQL}') THEN 'least' ELSE 'plain' END AS k FROM ({_WRITTEN}))""")
def parsed_values(spark, d):
    """Values as texts write them: numbers with a comma, deviations, reversed ranges, bounds in signs and words, none."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    plus = lambda n: (F.col("p_size") + n).cast("string")
    forms = [(F.lit("about "), s, F.lit(",5")), (F.lit("d = "), s, F.lit(" ± 2 mm")), (plus(9), F.lit("–"), s), (F.lit("≤ "), s), (F.lit("не менее "), s), (F.lit("from "), s, F.lit("…"), plus(3), F.lit(" K"))]
    written = F.lit("none given")
    for i, parts in enumerate(forms):
        written = F.when(k == i, F.concat(*parts)).otherwise(written)
    return table(spark, d, "part").select("p_partkey", numeric.parse_value(written).alias("v")).select("p_partkey", "v.*")


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_retailprice + 273.15 WHEN 1 THEN p_retailprice * 1000.0 WHEN 2 THEN p_retailprice * 60.0 WHEN 3 THEN p_retailprice * CAST(0.001 AS DOUBLE) ELSE p_retailprice END AS value, CASE p_size % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'MPa' WHEN 2 THEN 's' WHEN 3 THEN 'V' ELSE 'HV' END AS unit FROM part")
def canonical_units(spark, d):
    """Prices read as measurements in five units, in canonical units; hardness stays as it is."""
    unit = F.element_at(F.array(*(F.lit(u) for u in ["° C", "GPa", " min", "мВ", "HV"])), F.col("p_size") % 5 + 1)
    return table(spark, d, "part").select("p_partkey", numeric.canonical(F.col("p_retailprice"), unit).alias("v")).select("p_partkey", "v.value", "v.unit")


@query("SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE abs(l_extendedprice / l_quantity - p_retailprice) <= greatest(0.5, abs(p_retailprice) * 0.02)) AS n_close FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY l_linenumber")
def tolerance_match(spark, d):
    """Measured values within tolerance of the expected one."""
    rows = table(spark, d, "lineitem").where("l_quantity > 0").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    close = numeric.tolerant(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count(F.when(close, 1)).alias("n_close"))


@query("SELECT d.doc_id, 1.0 - CAST(d.n_chars - s.low AS DOUBLE) / CAST(s.span AS DOUBLE) AS score FROM documents d JOIN (SELECT source, min(n_chars) AS low, nullif(max(n_chars) - min(n_chars), 0) AS span FROM documents GROUP BY source) s USING (source)")
def min_max_scores(spark, d):
    """Scores scaled by the range of their source; the range is aggregated before the join."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    span = docs.groupBy("source").agg(F.min("n_chars").alias("low"), F.nullif(F.max("n_chars") - F.min("n_chars"), F.lit(0)).alias("span"))
    return docs.join(span, "source").select("doc_id", (F.lit(1.0) - (F.col("n_chars") - F.col("low")).cast("double") / F.col("span").cast("double")).alias("score"))


_GATE = ["released", "license", "qqzzvvx", "document"]


@query("""WITH t AS (SELECT 'released' AS term, max(contains(lower(text), 'released') OR contains(lower(text), 'releas') OR contains(lower(text), 'relea')) AS found FROM documents
  UNION ALL SELECT 'license', max(contains(lower(text), 'license') OR contains(lower(text), 'licen')) FROM documents UNION ALL SELECT 'qqzzvvx', max(contains(lower(text), 'qqzzvvx') OR contains(lower(text), 'qqzzv')) FROM documents
  UNION ALL SELECT 'document', max(contains(lower(text), 'document') OR contains(lower(text), 'docume') OR contains(lower(text), 'docum')) FROM documents)
  SELECT term, coalesce(found, false) AS found, (SELECT count(*) FROM t WHERE NOT coalesce(found, false)) * 2 >= 4 AS gated FROM t""")
def honesty_gate(spark, d):
    """Which terms of a question the corpus has in any form, and whether half are absent; one pass over the texts."""
    docs = table(spark, d, "documents")
    seen = docs.agg(*(F.coalesce(F.max(numeric.in_any_form(F.col("text"), w)), F.lit(False)).alias(w) for w in _GATE))
    absent = sum(((~F.col(w)).cast("int") for w in _GATE), F.lit(0))
    rows = seen.select(F.explode(F.array(*(F.struct(F.lit(w).alias("term"), F.col(w).alias("found")) for w in _GATE))).alias("t"), (absent * 2 >= len(_GATE)).alias("gated"))
    return rows.select("t.term", "t.found", "gated")


# -- search, grids, windows, quality ----------------------------------------------------------


def passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as passages, whole."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("claim").alias("source"), F.col("source").alias("doc_name"), F.lit("finding").alias("kind"), "text", F.left("text", F.lit(300)).alias("snippet"))


_ASKED = ["released", "under", "license", "apache", "qqzzvv"]
_HAS = {t: f"(contains(b, '{t}')" + (f" OR contains(b, '{t[:-2]}')" if len(t) > 5 else "") + ")" for t in _ASKED}


@query(f"""WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS doc, text, left(text, 300) AS snippet, lower(text || ' ' || left(text, 300)) AS b FROM documents), f AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {h}) AS d_{t}" for t, h in _HAS.items())} FROM p),
  s AS (SELECT id, doc, snippet, round(({" + ".join(f"CASE WHEN {h} THEN ln(1 + (n - d_{t} + 0.5) / (d_{t} + 0.5)) ELSE 0.0 END" for t, h in sorted(_HAS.items()))}) * CASE WHEN regexp_matches(b, '[0-9]') THEN 1.6 ELSE 1.0 END, 9) AS rank FROM p, f WHERE {" OR ".join(_HAS.values())}),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc, left(snippet, 60) ORDER BY rank DESC, id) AS r FROM s) SELECT id, snippet, doc, CAST(floor(rank * 1e6 + 0.5) AS BIGINT) AS rank_e6 FROM r WHERE r = 1 ORDER BY rank DESC, id LIMIT 10""")
def search_passages(spark, d):
    """Passages for a question of which one term is nowhere: gate, weights of terms, one of each document and opening."""
    found = search.search(passages(spark, d), "Released under Apache license qqzzvv?", 10).passages
    return found.select("id", "snippet", "doc", F.floor(F.col("rank") * 1e6 + 0.5).cast("long").alias("rank_e6"))


@query(f"""WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT doc_id, sum(CASE WHEN term IN ('license', 'mit', 'apache', 'public') THEN n ELSE 0 END) / (sqrt(sum(n * n)) * 2.0) AS score FROM c GROUP BY doc_id)
  SELECT doc_id, CAST(floor(score * 1e9 + 0.5) AS BIGINT) AS score_e9 FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 25""")
def sparse_cosine(spark, d):
    """The 25 documents nearest to a query by counts of terms."""
    return retrieval.sparse(table(spark, d, "documents"), _WORDS, 25).select("doc_id", F.floor(F.col("score") * 1e9 + 0.5).cast("long").alias("score_e9"))


_CLASSED = f"SELECT *, CASE WHEN size < 15 THEN 'low' WHEN size <= 35 THEN 'medium' ELSE 'high' END AS bucket FROM ({_FACTS})"


@query(f"SELECT a.family, b.process, c.bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT family FROM ({_CLASSED}) WHERE value > 60000) a CROSS JOIN (SELECT DISTINCT process FROM ({_CLASSED}) WHERE value > 60000) b CROSS JOIN (SELECT DISTINCT bucket FROM ({_CLASSED}) WHERE value > 60000) c LEFT JOIN (SELECT family, process, bucket, count(*) AS n FROM ({_CLASSED}) WHERE value > 60000 GROUP BY ALL) f ON f.family = a.family AND f.process = b.process AND f.bucket = c.bucket")
def coverage_cube(spark, d):
    """Results for every family, process and class of size, 0 where there are none."""
    bucket = F.when(F.col("size") < 15, "low").when(F.col("size") <= 35, "medium").otherwise("high")
    return evidence.grid_counts(facts(spark, d).where("value > 60000").select("family", "process", bucket.alias("bucket")), ["family", "process", "bucket"])


@query(f"SELECT process, count(*) AS n_docs, string_agg(CAST(document AS VARCHAR), ',' ORDER BY document) FILTER (WHERE r <= 10) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY process ORDER BY document) AS r FROM (SELECT DISTINCT process, document FROM ({_FACTS}))) GROUP BY process")
def review_groups(spark, d):
    """Documents of each process, and the first ten."""
    found = evidence.documents_by(facts(spark, d), "process", "document")
    return found.select("process", "n_docs", F.array_join(F.transform("docs", lambda x: x.cast("string")), ",").alias("docs"))


@query(f"""SELECT src_type, src, dst_type, dst, count(*) AS n FROM (SELECT 'family' AS src_type, family AS src, 'grade' AS dst_type, grade AS dst FROM ({_FACTS}) UNION ALL SELECT 'grade', grade, 'process', process FROM ({_FACTS}) WHERE process <> '5-LOW'
  UNION ALL SELECT 'process', process, 'country', country FROM ({_FACTS}) WHERE process <> '5-LOW' UNION ALL SELECT 'grade', grade, 'country', country FROM ({_FACTS}) WHERE process = '5-LOW') GROUP BY ALL""")
def graph_overview(spark, d):
    """Links between adjacent dimensions of results, across a dimension that a result lacks."""
    rows = facts(spark, d).withColumn("process", F.when(F.col("process") != "5-LOW", F.col("process")))
    return graph.overview(rows, ["family", "grade", "process", "country"])[1]


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest(range(4)) AS k) GROUP BY ALL")
def sliding_counts(spark, d):
    """Events of each type in hours that begin every quarter of an hour."""
    rows = windows.sliding_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, d):
    """Events of each user without a pause of half an hour."""
    rows = windows.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT p_partkey, CASE WHEN t < 673.15 THEN 'low' WHEN t < 1073.15 THEN 'medium' ELSE 'high' END AS regime, CASE WHEN t < 323.15 THEN 'room' ELSE concat('>', CAST(CAST(floor((t - 273.15) / 100) * 100 AS BIGINT) AS VARCHAR), 'C') END AS temperature,
  CASE p_size % 4 WHEN 0 THEN 'pressure' WHEN 1 THEN 'ratio' WHEN 2 THEN 'time' ELSE 'furlong' END AS dimension FROM (SELECT *, p_size * 30.0 AS t FROM part)""")
def value_classes(spark, d):
    """Classes of temperature and regime, and what units measure."""
    t = F.col("p_size") * 30.0
    unit = F.element_at(F.array(*map(F.lit, ["GPa", "%", "min", " Furlong"])), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select("p_partkey", numeric.regime_class(t).alias("regime"), numeric.temperature_class(t).alias("temperature"), numeric.dimension(unit).alias("dimension"))


@query("SELECT doc_id, i, line FROM (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS z FROM (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE line <> '') WHERE a <= 2 OR z <= 2")
def edge_lines(spark, d):
    """The first and the last two lines of each document that aren't empty."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where("line <> ''")
    return retrieval.ends_per_key(lines, ["doc_id"], "i", 2)


@query("""SELECT category, count(*) AS n, count(*) FILTER (WHERE ok) AS ok, CAST(floor(coalesce(round(sum(score * weight) FILTER (WHERE ok) / sum(weight) FILTER (WHERE ok), 3), 0.0) * 1000 + 0.5) AS BIGINT) AS score_e3, CAST(floor(coalesce(round(avg(CASE WHEN score >= 0.6 THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 3), 0.0) * 1000 + 0.5) AS BIGINT) AS pass_e3
  FROM (SELECT event_type AS category, event_id % 10 <> 0 AS ok, (event_id % 7) / 8.0 AS score, CAST(user_id % 3 + 1 AS DOUBLE) AS weight FROM events) GROUP BY category""")
def score_by_question(spark, d):
    """Weighted scores and shares of passes by category, of events read as questions."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("category"), (F.col("event_id") % 10 != 0).alias("ok"), ((F.col("event_id") % 7) / 8.0).alias("score"), (F.col("user_id") % 3 + 1).cast("double").alias("weight"))
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return quality.by_category(rows).select("category", "n", "ok", milli("score").alias("score_e3"), milli("pass_rate").alias("pass_e3"))


@query("SELECT event_type, count(*) AS n, min(k) AS low, max(k) AS high FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def event_props(spark, d):
    """Range of a field of the events' JSON."""
    rows = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, array_to_string([x FOR x IN [CASE WHEN NOT l_quantity < 45 THEN 'quantity' END, CASE WHEN NOT l_discount <= 0.08 THEN 'discount' END] IF x IS NOT NULL], ',') AS broken FROM lineitem WHERE NOT (l_quantity < 45 AND l_discount <= 0.08)")
def rejects(spark, d):
    """Rows that break constraints, with the names of those."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    bad = evidence.validated(rows, {"quantity": F.col("l_quantity") < 45, "discount": F.col("l_discount") <= 0.08})[1]
    return bad.drop("l_quantity", "l_discount").withColumn("broken", F.array_join("broken", ","))


@query(f"SELECT experiment, kind, year FROM (SELECT *, CASE WHEN document % 3 <> 0 THEN year END AS y FROM ({_FACTS})) WHERE kind IN (1, 2) AND coalesce(y >= 1996, true) AND coalesce(y <= 1997, true)")
def post_filtered(spark, d):
    """Results of two kinds that aren't known to be of other years."""
    rows = facts(spark, d).withColumn("known", F.when(F.col("document") % 3 != 0, F.col("year")))
    found = search.post_filter(rows.withColumnRenamed("year", "own").withColumnRenamed("known", "year"), [1, 2], 1996, 1997)
    return found.select("experiment", "kind", F.col("own").alias("year"))


@query("SELECT c_custkey FROM customer WHERE list_contains(string_split(lower(c_mktsegment), 'i'), 'ture') OR regexp_matches(lower(c_mktsegment), 'machin') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)")
def experts_or_process(spark, d):
    """Labs whose expertise has a stem, or that ran an experiment of a process."""
    labs = table(spark, d, "customer")
    fits = F.exists(F.split(F.lower("c_mktsegment"), "i"), lambda x: x == "ture") | F.lower("c_mktsegment").rlike("machin")
    ran = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("ran", F.lit(True))
    return labs.join(ran, "c_custkey", "left").where(fits | F.coalesce("ran", F.lit(False))).select("c_custkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_profile(spark, sf_dir)
