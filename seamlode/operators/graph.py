"""Edges, neighbourhoods, paths, lineage, components and upserts by bounded joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _touching(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(node, next) for every raw edge at a frontier node; each side of the edges meets the frontier on its own, before any distinct."""
    out = edges.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("node"), F.col("dst").alias("next"))
    return out.unionByName(edges.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.col("dst").alias("node"), F.col("src").alias("next")))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, depth): nodes within ``hops`` undirected steps of start(node)."""
    edges = edges.select("src", "dst")
    seen = start.select("node", F.lit(0).alias("depth"))
    frontier = start.select("node")
    for depth in range(1, hops + 1):
        reached = _touching(edges, frontier).select(F.col("next").alias("node")).distinct()
        frontier = reached.join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier.select("node", F.lit(depth).alias("depth")))
    return seen


def subgraph(edges: DataFrame, start: DataFrame, hops: int, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, depth), edges) about start(node): no further hop once more than ``most`` nodes are reached, so the bound is soft."""
    seen, reached = start.select("node", F.lit(0).alias("depth")), start.select("node")
    for depth in range(1, max(1, hops) + 1):
        if reached.isEmpty() or seen.limit(most + 1).count() > most:
            break
        reached = _touching(edges, reached).select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti").persist()
        seen = seen.unionByName(reached.select("node", F.lit(depth).alias("depth")))
    expanded = seen.where(F.col("depth") < F.lit(seen.agg(F.max("depth")).first()[0] or 1))
    ends = expanded.select("node")
    own = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(edges.join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return seen, own.dropDuplicates(["src", "dst", "predicate"])


def paths(edges: DataFrame, start: DataFrame, hops: int, same_source: bool = False) -> DataFrame:
    """(start, node, depth, nodes): undirected paths of 1 to ``hops`` steps that use no edge twice, from start(node, sources).

    edges(src, dst, sources, and others); with same_source every step shares a source with the start.
    """
    if not 1 <= hops <= 4:
        raise ValueError("1 to 4 steps")
    key = F.struct(*(c for c in ("src", "dst", "predicate") if c in edges.columns))
    one = edges.select("src", "dst", "sources", key.alias("edge"))
    both = one.select(F.col("src").alias("at"), F.col("dst").alias("next"), "sources", "edge").unionByName(one.where("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("next"), "sources", "edge"))
    now = start.select(F.col("node").alias("start"), F.col("sources").alias("own"), F.col("node").alias("at"), F.array("node").alias("nodes"), F.array().cast(f"array<{one.schema['edge'].dataType.simpleString()}>").alias("used"))
    found = None
    for depth in range(1, hops + 1):
        step = now.join(both, "at").where(~F.array_contains("used", F.col("edge")))
        if same_source:
            step = step.where(F.arrays_overlap("sources", "own"))
        now = step.select("start", "own", F.col("next").alias("at"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("used", F.array("edge")).alias("used"))
        part = now.select("start", F.col("at").alias("node"), F.lit(depth).alias("depth"), "nodes", "used")
        found = part if found is None else found.unionByName(part)
    return found


def neighbourhood_edges(edges: DataFrame, start: DataFrame, hops: int, same_source: bool = False, most: int = 200) -> DataFrame:
    """Distinct edges on the paths about a start, ``most`` at most, in order."""
    used = paths(edges, start, hops, same_source).select(F.explode("used").alias("e")).select("e.*").distinct()
    return used.orderBy(*used.columns).limit(most)


def shortest_path(edges: DataFrame, source: str, target: str, hops: int = 6) -> list[str]:
    """Nodes of a shortest undirected path, the smallest of them by name; empty if there is none within ``hops``."""
    spark = edges.sparkSession
    first = spark.range(1).select(F.lit(source).alias("node"))
    layers, seen = [first], first
    for _ in range(hops):
        if not layers[-1].where(F.col("node") == target).isEmpty():
            break
        step = _touching(edges, layers[-1]).join(seen.select(F.col("node").alias("next")), "next", "left_anti")
        layers.append(step.groupBy(F.col("next").alias("node")).agg(F.min("node").alias("before")).persist())
        seen = seen.unionByName(layers[-1].select("node"))
    out, at = [], target
    for layer in reversed(layers):
        row = layer.where(F.col("node") == at).first()  # one row a step
        if row is None:
            return []
        out.append(at)
        at = row["before"] if "before" in layer.columns else None
    return out[::-1]


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with no incident edge."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return nodes.join(ends, "node", "left_anti")


def lineage(steps: DataFrame, roots: DataFrame, limit: int = 12) -> DataFrame:
    """(root, node, depth) along steps(src, dst); diamonds repeat, depth stays below the limit.

    One recursive plan: each layer is joined once, and an empty layer ends it.
    """
    spark = steps.sparkSession
    steps.select("src", "dst").createOrReplaceTempView("seamlode_steps")
    roots.select("root").createOrReplaceTempView("seamlode_roots")
    return spark.sql(
        f"""WITH RECURSIVE chain(root, node, depth) MAX RECURSION LEVEL {limit + 1} AS (
          SELECT root, root, 0 FROM seamlode_roots
          UNION ALL SELECT c.root, s.dst, c.depth + 1 FROM chain c JOIN seamlode_steps s ON c.node = s.src WHERE c.depth < {limit - 1})
        SELECT root, node, depth FROM chain LIMIT ALL"""
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by label propagation with pointer jumping; root is the smallest node.

    Each round takes the least label about a node and follows labels one step, with map-side combined minima.
    Rounds are cut by checkpoints where the session names a folder for them, else kept in memory.
    """
    spark = edges.sparkSession
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df.persist())
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    labels = keep(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root")).select(F.col("src").alias("node"), "root"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        least = labels.join(near, "node").select("node", F.least("root", "near").alias("hop"))
        jumped = least.join(labels.select(F.col("node").alias("hop"), F.col("root").alias("far")), "hop").select("node", F.least("hop", "far").alias("root"))
        after = keep(jumped)
        if after.join(labels, ["node", "root"], "left_anti").isEmpty():
            return after
        labels = after


def overview(rows: DataFrame, chain: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes(type, label, n), edges(src_type, src, dst_type, dst, n)) of rows that name one thing of each type of the chain.

    Adjacent types are linked; where a row lacks one, its neighbours on either side are linked instead.
    """
    held = F.array(*(F.struct(F.lit(t).alias("type"), F.col(t).cast("string").alias("label")) for t in chain))
    there = rows.select(F.filter(held, lambda x: x["label"].isNotNull()).alias("held"))
    nodes = there.select(F.explode("held").alias("x")).groupBy("x.type", "x.label").agg(F.count("*").alias("n"))
    pairs = F.arrays_zip(F.slice("held", 1, F.greatest(F.size("held") - 1, F.lit(0))).alias("a"), F.slice("held", 2, F.greatest(F.size("held") - 1, F.lit(0))).alias("b"))
    links = there.where(F.size("held") > 1).select(F.explode(pairs).alias("p")).select(F.col("p.a.type").alias("src_type"), F.col("p.a.label").alias("src"), F.col("p.b.type").alias("dst_type"), F.col("p.b.label").alias("dst"))
    return nodes, links.groupBy("src_type", "src", "dst_type", "dst").agg(F.count("*").alias("n"))


# -- upserts ------------------------------------------------------------------------------


def upsert_new(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The target and those rows whose key it lacks; of rows of one key the least, so a second load adds nothing."""
    others = [c for c in target.columns if c not in key]
    one = rows.groupBy(*key).agg(F.min(F.struct(*others)).alias("r")).select(*key, "r.*") if others else rows.select(*key).distinct()
    return target.unionByName(one.join(target.select(*key), key, "left_anti").select(*target.columns))


def merge_nodes(nodes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One node for each (text, type), with the union of its sources and, if nodes have any, the latest embedding.

    nodes(text, type, sources, and perhaps embedding with its place); state: nodes from before, whose embedding a new one replaces.
    """
    empty = F.array().cast("array<string>")
    vector = "embedding" in nodes.columns
    new = [F.collect_list(F.coalesce("sources", empty)).alias("lists")]
    if vector:
        new.append(F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("place") if "place" in nodes.columns else F.lit(0))).alias("embedding"))
    rows = nodes.groupBy("text", "type").agg(*new).withColumn("sources", F.array_sort(F.array_distinct(F.flatten("lists")))).drop("lists")
    if state is None:
        return rows.select("text", "type", "sources", *(["embedding"] if vector else []))
    before = state.select("text", "type", F.col("sources").alias("had"), *([F.col("embedding").alias("old")] if vector else []))
    out = rows.join(before, ["text", "type"], "full").withColumn("sources", F.array_sort(F.array_union(F.coalesce("had", empty), F.coalesce("sources", empty))))
    return out.select("text", "type", "sources", *([F.coalesce("embedding", "old").alias("embedding")] if vector else []))


def merge_edges(edges: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One edge for each (src, predicate, dst): the verb of the first, the union of the sources. edges(src, predicate, dst, verb, source, place)."""
    rows = edges.groupBy("src", "predicate", "dst").agg(F.min_by("verb", "place").alias("verb"), F.array_sort(F.collect_set("source")).alias("sources"))
    if state is None:
        return rows
    before = state.select("src", "predicate", "dst", F.col("verb").alias("first"), F.col("sources").alias("had"))
    empty = F.array().cast("array<string>")
    out = rows.join(before, ["src", "predicate", "dst"], "full")
    return out.select("src", "predicate", "dst", F.coalesce("first", "verb").alias("verb"), F.array_sort(F.array_union(F.coalesce("had", empty), F.coalesce("sources", empty))).alias("sources"))


def backfilled(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """nodes with the embeddings of vectors(text, type, embedding) where they have none."""
    got = vectors.select("text", "type", F.col("embedding").alias("given"))
    return nodes.join(got, ["text", "type"], "left").withColumn("embedding", F.coalesce("embedding", "given")).drop("given")


def without_embedding(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.where("embedding is null").orderBy("text", "type").limit(most)


def remap(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """Ends rewritten by variants(variant, canonical); loops and repeats go."""
    a = variants.select(F.col("variant").alias("src"), F.col("canonical").alias("new_src"))
    b = variants.select(F.col("variant").alias("dst"), F.col("canonical").alias("new_dst"))
    out = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "predicate")
    return out.where("src <> dst").distinct()


def touched(edges: DataFrame, variants: DataFrame) -> DataFrame:
    """Edges with either end among variants(variant)."""
    v = variants.select("variant").distinct()
    at = lambda end: edges.join(v.withColumnRenamed("variant", end), end, "left_semi").select(*edges.columns)
    return at("src").unionByName(at("dst")).distinct()


def rewrite_uses(batch: DataFrame, variants: DataFrame) -> DataFrame:
    """Batches with the material ids in their arrays rewritten: experiments array<struct<id, materials array<struct<material_id, role>>>>; repeated uses go."""
    uses = batch.select("batch_id", F.posexplode("experiments").alias("e_at", "e")).select("batch_id", "e_at", F.col("e.id").alias("id"), F.posexplode_outer("e.materials").alias("m_at", "m"))
    v = variants.select(F.col("variant").alias("material_id"), "canonical")
    uses = uses.select("batch_id", "e_at", "id", "m_at", "m.material_id", F.coalesce("m.role", F.lit("sample")).alias("role")).join(v, "material_id", "left").withColumn("material_id", F.coalesce("canonical", "material_id"))
    once = uses.groupBy("batch_id", "e_at", "id", "material_id", "role").agg(F.min("m_at").alias("m_at"))
    use = F.when(F.col("material_id").isNotNull(), F.struct("m_at", "material_id", "role"))
    per = once.groupBy("batch_id", "e_at", "id").agg(F.transform(F.array_sort(F.collect_list(use)), lambda x: F.struct(x["material_id"].alias("material_id"), x["role"].alias("role"))).alias("materials"))
    done = per.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("e_at", "id", "materials"))), lambda x: F.struct(x["id"].alias("id"), x["materials"].alias("materials"))).alias("experiments"))
    return batch.drop("experiments").join(done, "batch_id", "left")


def canonical_plan(materials: DataFrame) -> DataFrame:
    """materials(id, name, canonical, family, grade, phase, composition) with ``root``, ``exact`` and ``merge``.

    root: the least id of its canonical name. exact: the name is that of the canonical one but for case, endings and
    punctuation. merge: exact, in a group of two such or more whose grades, phases and compositions don't differ.
    """
    from seamlode.functions.text import number_stem

    group = Window.partitionBy("canonical")
    rows = materials.withColumn("root", F.min("id").over(group)).withColumn("exact", number_stem(F.col("name")) == number_stem(F.col("canonical")))
    for c in ("grade", "phase", "composition"):
        own = F.when(F.col("exact"), F.nullif(F.col(c).cast("string"), F.lit("")))
        rows = rows.withColumn(f"_{c}", F.min(own).over(group).eqNullSafe(F.max(own).over(group)))
    alike = F.col("_grade") & F.col("_phase") & F.col("_composition")
    n = F.count(F.when(F.col("exact"), 1)).over(group)
    return rows.withColumn("merge", F.col("exact") & (n >= 2) & alike).drop("_grade", "_phase", "_composition")


def soft_links(plan: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(source_id, canonical_id) of materials that share a canonical name; those of state are left out."""
    links = plan.where("id <> root").select(F.col("id").alias("source_id"), F.col("root").alias("canonical_id"))
    return links if state is None else links.join(state.select("source_id", "canonical_id"), ["source_id", "canonical_id"], "left_anti")


def hard_merge(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(materials, variants(variant, canonical)): exact variants merged into one row with the commonest family."""
    group = Window.partitionBy("canonical")
    root = F.min(F.when(F.col("merge"), F.col("id"))).over(group)
    rows = plan.withColumn("into", F.when(F.col("merge"), root))
    variants = rows.where("merge and id <> into").select(F.col("id").alias("variant"), F.col("into").alias("canonical"))
    votes = rows.where("merge").groupBy("canonical", "family").agg(F.count("*").alias("n"))
    family = votes.groupBy("canonical").agg(F.min(F.struct((-F.col("n")).alias("down"), "family")).alias("f")).select("canonical", F.col("f.family").alias("voted"))
    kept = rows.join(variants.select(F.col("variant").alias("id")), "id", "left_anti").join(family, "canonical", "left")
    return kept.select("id", F.when(F.col("merge"), F.col("canonical")).otherwise(F.col("name")).alias("name"), F.when(F.col("merge"), F.col("voted")).otherwise(F.col("family")).alias("family")), variants


def fact_entities(entities: DataFrame) -> DataFrame:
    """entities(doc_id, canonical, label, surface) as one row each: uses, documents and forms."""
    return entities.groupBy("canonical", "label").agg(F.count("*").alias("n_occurrences"), F.array_sort(F.collect_set("doc_id")).alias("source_docs"), F.array_sort(F.collect_set("surface")).alias("surface_forms"))


def fact_relations(relations: DataFrame) -> DataFrame:
    """relations(doc_id, phrase, relation) as one row a phrase, blanks and case aside."""
    key = F.lower(F.trim(F.regexp_replace("phrase", r"\s+", " ")))
    rows = relations.withColumn("key", key).where(F.length("key") >= 2)
    return rows.groupBy("key").agg(F.min(F.struct("phrase", "relation")).alias("f"), F.count("*").alias("n_occurrences"), F.array_sort(F.collect_set("doc_id")).alias("source_docs")).select("key", "f.phrase", "f.relation", "n_occurrences", "source_docs")
