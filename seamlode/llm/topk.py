"""Exact top-k inner products, filtered by multi-resolution segment statistics.

Vectors become integers. Each is summarised at several resolutions by the
mean and deviation of equal segments. With d(q, x)^2 >= sum of
n * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2) over segments, the inner product
(|q|^2 + |x|^2 - d^2) / 2 is bounded from above; the bounds are taken coarse to
fine and exact scores only for those that may still reach the k-th best.

Rows are packed into blocks of vectors. A query starts with the k-th best score of the
block that it stands in, which is found as query blocks are packed and goes with them, so every
other block is filtered from its first bound on. Each query block meets each candidate
block once, in its own row of a join on the cells of a grid, and gives at most k rows
a query, so no task holds more than one pair of blocks. The join is never a broadcast: query
blocks are few before they are copied to the grid's rows, but not after. Blocks hold their components
in the fewest bytes that hold all of them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamlode.llm.common import partitions, staged

CANDIDATES, QUERIES = 4096, 512
LEVELS = (1, 4, 16, 32)
_EXACT = 2.0**52
_BLOCK = "block long, n int, dim int, ids binary, vectors binary, at binary, least binary"


def quantised(vector: list | None, scale: float) -> list[int] | None:
    """floor(scale * x) of each component, or None if one is null or not finite."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.array(vector, float)
    if not np.isfinite(v).all():
        return None
    v = np.floor(scale * v)
    return v if np.isfinite(v).all() else None


def _packed(m: np.ndarray) -> bytes:
    """Whole numbers in 2 or 4 bytes each if all fit, else in 8 as doubles."""
    most = float(np.abs(m).max(initial=0))
    return m.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8").tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = {2: "<i2", 4: "<i4"}.get(len(data) // max(1, n * dim), "<f8")
    return np.frombuffer(data, kind).reshape(n, dim).astype(float)


def _pack(block: int, rows: list[tuple[int, np.ndarray, int, float]]) -> tuple:
    dim = max((len(r[1]) for r in rows), default=0)
    m = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        m[i, : len(r[1])] = r[1]
    ids, at, least = (np.array([r[k] for r in rows], kind) for k, kind in ((0, "<i8"), (2, "<i8"), (3, float)))
    return block, len(rows), dim, ids.tobytes(), _packed(m), at.tobytes(), least.tobytes()


def _batch(blocks: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*blocks)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["block", "n", "dim", "ids", "vectors", "at", "least"])


def _big(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether products of these may be inexact as doubles."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] >= _EXACT


def _asked(block: int, n: int, dim: int, ids: bytes, vectors: bytes, every: int, k: int) -> list[tuple]:
    """(id, vector, place, k-th best score in this block) of the queries of a block."""
    m, ids = _unpacked(vectors, n, dim), np.frombuffer(ids, "<i8")
    rows = np.flatnonzero(ids % every == 0)
    least = np.full(len(rows), -np.inf)
    if n > k and len(rows) and not _big(m[rows], m):
        scores = m[rows] @ m.T
        scores[np.arange(len(rows)), rows] = -np.inf
        least = np.partition(scores, n - k, axis=1)[:, n - k]
    return [(int(ids[i]), m[i], block << 13 | int(i), float(s)) for i, s in zip(rows, least)]


def _blocks(rows: DataFrame, size: int, scale: float | None, every: int | None = None, k: int = 0) -> DataFrame:
    """Pack rows (id, vector), or with ``every`` the rows of a packed table whose id it divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId() << 32, 0, []
        for b in batches:
            if every is None:
                pairs = ((i, quantised(v, scale)) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
                held += [(i, v, 0, 0.0) for i, v in pairs if v is not None and i is not None]
            else:
                for row in zip(*(c.to_pylist() for c in b.columns[:5])):
                    held += _asked(*row, every, k)
            full = []
            while len(held) >= size:
                full.append(_pack(part + seq, held[:size]))
                held, seq = held[size:], seq + 1
            if full:
                yield _batch(full)
        yield _batch([_pack(part + seq, held)] if held else [])

    return rows.mapInArrow(run, _BLOCK)


def _stats(m: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment means and deviations, each times the root of its segment's length."""
    cuts = np.linspace(0, m.shape[1], parts + 1).astype(int)
    cuts = np.unique(cuts)
    n = np.diff(cuts)
    means = np.add.reduceat(m, cuts[:-1], axis=1) / n
    devs = np.sqrt(np.maximum(np.add.reduceat(m * m, cuts[:-1], axis=1) / n - means**2, 0))
    return means * np.sqrt(n), devs * np.sqrt(n)


def _scores(x: np.ndarray, q: np.ndarray, big: bool) -> list[int] | np.ndarray:
    if not big:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in x]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def best_in_block(q: np.ndarray, q_at: np.ndarray, least: np.ndarray, x: np.ndarray, x_ids: np.ndarray, x_at: np.ndarray, k: int, tally: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: (row, ids, scores) of its k best candidates of the block that score ``least`` at least.

    tally gets the number of pairs that are left before each level, and of those scored exactly.
    """
    width = max(q.shape[1], x.shape[1], 1)
    q, x = _padded(q, width), _padded(x, width)
    big = _big(q, x)
    live = np.ones((len(q), len(x)), bool)
    own = {int(a): j for j, a in enumerate(x_at)}
    for i, a in enumerate(q_at.tolist()):
        if a in own:
            live[i, own[a]] = False
    tally = [] if tally is None else tally
    tally.append(int(live.sum()))
    with np.errstate(over="ignore", invalid="ignore"):
        slack = 1e-9 * ((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]) + 1e-6
        for parts in () if big else LEVELS:
            if parts > width or not live.any():
                break
            (mq, sq), (mx, sx) = _stats(q, parts), _stats(x, parts)
            live &= ~(mq @ mx.T + sq @ sx.T + slack < least[:, None])  # an undefined bound keeps its pair
            tally.append(int(live.sum()))
    rows = np.flatnonzero(live.any(1))
    if not big and len(rows):
        # of the pairs left those that score enough; ties stay
        live[rows] &= q[rows] @ x.T >= least[rows, None]
    for i in range(len(q)):
        idx = np.flatnonzero(live[i])
        s = _scores(x[idx], q[i], big)
        order = np.lexsort((x_ids[idx], -s))[:k] if not (s == -(2**63)).any() else np.array(sorted(range(len(s)), key=lambda t: (-int(s[t]), int(x_ids[idx[t]])))[:k], int)
        yield i, x_ids[idx[order]], s[order]



def _grid(cells: int, every: int) -> tuple[int, int]:
    """Rows (of candidate blocks) and columns (of query blocks) of about so many cells that copy the fewest vectors.

    Candidates, ``every`` times as many as queries, are copied to each column and queries to each row.
    """
    high = max(1, min(cells, round((every * cells) ** 0.5)))
    return high, -(-cells // high)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products.

    Queries are the rows whose id ``every`` divides, candidates every row but the
    query's own; ties go to the smaller id. Rows of null id or vector, or of a null or
    non-finite component (also once scaled), take no part; shorter vectors count as
    padded with zeros, so empty ones score 0; scores beyond 64 bits saturate. Repeated rows of one
    id are queries and candidates each. Other columns are ignored, whatever their names; no rows
    give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    blocks = staged(_blocks(rows, CANDIDATES, scale), "vector-blocks")
    asked = _blocks(blocks, QUERIES, None, every, k)
    high, wide = _grid(partitions(spark), every)
    cell = lambda i, j: (i * F.lit(wide) + j).alias("g")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("other")
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).alias("own")
    left = blocks.select("*", place(high), upto(wide)).select(cell(F.col("own"), F.col("other")), *(F.col(c).alias(f"x_{c}") for c in ("block", "n", "dim", "ids", "vectors")))
    right = staged(asked, "query-blocks").select("*", place(wide), upto(high)).select(cell(F.col("other"), F.col("own")), *(F.col(c).alias(f"q_{c}") for c in ("n", "dim", "ids", "vectors", "at", "least")))
    pairs = left.hint("merge").join(right.hint("merge"), "g").drop("g").select("x_block", "x_n", "x_dim", "x_ids", "x_vectors", "q_n", "q_dim", "q_ids", "q_vectors", "q_at", "q_least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                xb, xn, xd, xi, xv, qn, qd, qi, qv, qa, ql = (c[r].as_py() for c in b.columns)
                x, q = _unpacked(xv, xn, xd), _unpacked(qv, qn, qd)
                x_ids, q_ids, q_at = np.frombuffer(xi, "<i8"), np.frombuffer(qi, "<i8"), np.frombuffer(qa, "<i8")
                found = list(best_in_block(q, q_at, np.frombuffer(ql, float), x, x_ids, (xb << 13) + np.arange(xn), k))
                count = [len(s) for _, _, s in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_at, count)), pa.array(np.repeat(q_ids, count)), pa.array(np.concatenate([np.empty(0, np.int64), *(i for _, i, _ in found)])), pa.array(np.concatenate([np.empty(0, np.int64), *(s for _, _, s in found)]))],
                    ["q_at", "query_id", "vec_id", "score"],
                )

    found = pairs.mapInArrow(run, "q_at long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_at", "query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
