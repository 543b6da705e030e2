"""Connected components by alternating star contraction (Kiveris et al., 2014).

Each half round groups the edges by a node, takes the smallest neighbour with a
map-side combined minimum and joins it back, so no neighbour list is ever held
in one task; the joins are plain equi-joins, whose large keys Spark splits. Rounds are
written to the shared folder, in as few files as their rows need. Before the
rounds each file's edges become stars of their own, chunk by chunk, and once the edges left are
few enough for one file, the same step is the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamlode.llm.common import FILE_ROWS, drop_staged, lean, staged

#: Edges that are made stars at once.
_CHUNK = 2 * FILE_ROWS


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """edges(u, v), u > v: each chunk of a task's edges as (node, smallest node of its component there)."""
    schema = edges.schema

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        up: dict = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for u, v in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        return pa.RecordBatch.from_arrays([pa.array(list(up), t.schema.field(0).type), pa.array(map(root, list(up)), t.schema.field(1).type)], ["u", "v"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= _CHUNK:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.mapInArrow(run, schema)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges(u, v) -> (node, root): root is the smallest node of the component.

    rows: about how many edges there are, if known. Loops and null ends are
    ignored; nodes without an edge do not appear. Empty input gives an empty result.
    """
    first = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges", rows)
    now = staged(_stars(first), "edges", rows)
    drop_staged(first)
    mark = _mark(now)
    while mark[0]:
        if mark[0] <= FILE_ROWS:
            after = staged(_stars(now.coalesce(1)), "edges")
            drop_staged(now)
            now = after
            break
        after = staged(_small_star(_large_star(now)), "edges", 2 * mark[0])
        drop_staged(now)
        now, last, mark = after, mark, _mark(after)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def extended(roots: DataFrame, links: DataFrame, rows: int | None = None) -> DataFrame:
    """roots(node, root) once links(u, v) join some of its classes; only the joined classes are looked at again."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    top = connected_components(ends, rows)
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(top.join(roots.select("node"), "node", "left_anti"))
