"""SimHash near-duplicate classes by bit-sliced Hamming comparison.

Fingerprints that may lie within the radius meet in buckets. A bucket's
fingerprints are stored vertically: plane b is an integer whose bit i is bit b
of fingerprint i. One query is compared with a whole block of them by XOR of
each plane, added into carry-save bitwise counters; a block is abandoned as
soon as every distance in it exceeds the radius.

Two bucketings:

* ``exact_keys``, for classes by distance: 8 blocks of bits, two left out at a time (28
  keys). Any two fingerprints of 64 bits within 2 bits share a key, and a bucket has at
  most 2**16 distinct fingerprints, whatever the size of the corpus.
* ``key_bits``, for classes by exact similarity: keys of chosen bits of a 256-bit fingerprint,
  longer and more of them as the corpus grows, with a stated probability that a
  pair of the least similarity meets. Candidates are then confirmed by their shingles.

Copies share a fingerprint, so groups of copies are one row before any bucket
is made, and buckets give a spanning forest of links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamlode.llm.common import lean, numbered, partitions, staged
from seamlode.llm.components import connected_components, extended

SEED = 42
_STEP = 1 << 16
_BLOCK = 1 << 12


def _hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1).tolist()
    return np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1
    )


def _majority(h: np.ndarray) -> np.ndarray:
    """Per bit, whether over half of the hashes set it; most significant first."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _STEP):
        part = h[at : at + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return ones * 2 > len(h)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """Further independent hashes of the same shingles (splitmix64 finaliser)."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> bytes:
    """64 bits; no words give all zeros."""
    h = _hashes(text, width, seed)
    return np.packbits(_majority(h)).tobytes() if len(h) else bytes(8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp binary) of every row; null text is empty, a text of any length is read whole."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), width) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp binary")


# -- buckets -----------------------------------------------------------------

_DROPS = list(combinations(range(8), 2))


def exact_keys(fp: Column) -> Column:
    """28 keys of a 64-bit fingerprint: six of its eight bytes each."""
    parts = [F.substring(fp, i + 1, 1) for i in range(8)]
    return F.array(*(
        F.struct(F.lit(k).alias("k"), F.concat(*(p for i, p in enumerate(parts) if i not in drop)).alias("key"))
        for k, drop in enumerate(_DROPS)
    ))


def exact_owner(diff: int) -> int:
    """The one key of those two fingerprints share that reports their link."""
    blocks = [i for i in range(8) if diff >> (8 * (7 - i)) & 255]
    return next(k for k, drop in enumerate(_DROPS) if set(blocks) <= set(drop))


def sliced(fps: list[int], bits: int) -> list[int]:
    """Bit planes: bit i of plane b is bit b of fingerprint i."""
    raw = np.frombuffer(b"".join(f.to_bytes(bits // 8, "little") for f in fps), np.uint8).reshape(len(fps), -1)
    planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in planes]


def within(planes: list[int], full: int, query: int, radius: int, live: list[int]) -> int:
    """Bits of those whose distance to query is at most radius.

    The carry-save counter starts so that its top bit is set by the first
    distance past the radius; set top bits stay, and a block whose every bit is
    set is abandoned.
    """
    size = radius.bit_length() + 1
    top = 1 << (size - 1)
    start = top - 1 - radius
    count = [full if start >> j & 1 else 0 for j in range(size - 1)]
    over = 0
    for b in live:
        carry = planes[b] ^ full if query >> b & 1 else planes[b]
        for j in range(size - 1):
            if not carry:
                break
            count[j], carry = count[j] ^ carry, count[j] & carry
        over |= carry
        if over == full:
            return 0
    return full & ~over


def bucket_links(fps: list[int], bits: int, radius: int, owner=None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints of a bucket."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in range(0, len(fps), _BLOCK):
        block = fps[at : at + _BLOCK]
        planes, full = sliced(block, bits), (1 << len(block)) - 1
        for i in range(min(len(fps), at + len(block))):
            inside = i - at
            hits = within(planes, full, fps[i], radius, range(bits))
            if inside >= 0:
                hits = hits >> (inside + 1) << (inside + 1)
            while hits:
                j = at + (hits & -hits).bit_length() - 1
                hits &= hits - 1
                if owner is not None and not owner(fps[i] ^ fps[j]):
                    continue
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield fps[i], fps[j]


def links(distinct: DataFrame) -> DataFrame:
    """distinct(fp) of 64 bits -> edges(u, v) of fingerprints within 2 bits."""
    dealt = (
        distinct.select("fp", F.explode(exact_keys(F.col("fp"))).alias("b")).select("b.k", "b.key", "fp")
        .repartition(partitions(distinct.sparkSession), "k", "key").sortWithinPartitions("k", "key", "fp")
    )

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                k = held_key[0]
                fps = [int.from_bytes(x, "big") for x in held]
                out.extend(bucket_links(fps, 64, 2, lambda d: exact_owner(d) == k))

        def batch() -> pa.RecordBatch:
            ends = [pa.array([x[i].to_bytes(8, "big") for x in out], pa.binary()) for i in (0, 1)]
            out.clear()
            return pa.RecordBatch.from_arrays(ends, ["u", "v"])

        for b in batches:
            for k, key, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (k, key) != held_key:
                    close()
                    held_key, held = (k, key), []
                    if len(out) > 10_000:
                        yield batch()
                held.append(fp)
        close()
        yield batch()

    return dealt.mapInArrow(run, "u binary, v binary")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id whose row can be reached.

    Linked are rows whose fingerprints differ in at most 2 of 64 bits; no link is lost. Empty
    texts have the zero fingerprint and link like any other; rows of null id keep a component
    if a row of their class has an id, else null. Rows may repeat and each get a
    row; other columns are ignored, whatever their names; no rows give no rows.
    """
    prints = staged(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    n = distinct.count()
    roots = connected_components(links(distinct.select("fp")), n)
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    member = staged(member, "simhash-member", n)
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(member.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


# -- one of each, by exact similarity ------------------------------------------

#: Of the 128 bits compared. At a Jaccard of 0.8 a bit differs with probability 0.15, 0.19 for the shortest texts.
RADIUS_128 = 39
#: A pair whose bits differ with probability ``MISS`` shares a key with probability ``RECALL``.
MISS, RECALL = 0.17, 0.98
_SMALL = 32
#: Shingles that a task of ``_alike`` keeps.
_HELD = 4 << 20


def _shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles, sorted."""
    return np.unique(_hashes(text, width, SEED))


def key_bits(n: int) -> list[np.ndarray]:
    """The bits of each key for n fingerprints: more and longer keys as n grows, so that buckets stay small."""
    size = max(10, n.bit_length() - 4)
    count = int(np.ceil(np.log(1 - RECALL) / np.log(1 - (1 - MISS) ** size)))
    rng = np.random.default_rng(SEED)
    return [rng.choice(256, size, replace=False) for _ in range(count)]


def _nodes(docs: DataFrame, width: int) -> DataFrame:
    """docs(uid, text) -> (node, f0..f3): the least uid of each set of shingles, and its 256 bits."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, fps = [], []
            for t in b.column(1):
                h = _shingles(t.as_py(), width)
                marks.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append(b"".join(np.packbits(_majority(h if k == 0 else _mix(h, k))).tobytes() for k in range(4)) if len(h) else bytes(32))
            f = np.frombuffer(b"".join(fps), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.binary()), *(pa.array(f[:, i]) for i in range(4))], ["uid", "mark", *_F])

    found = docs.mapInArrow(run, "uid long, mark binary, " + ", ".join(f"{c} long" for c in _F))
    return found.groupBy("mark").agg(F.min("uid").alias("node"), *(F.first(c).alias(c) for c in _F)).select("node", *_F)


_F = ["f0", "f1", "f2", "f3"]
_COMPARED = _F[:2]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)  # of signed values it would count the magnitude


def _planes(f: np.ndarray) -> tuple[list[int], list[int], int]:
    """Fingerprints of a bucket as integers and as bit planes, and a bit for each."""
    whole = [int.from_bytes(x.tobytes(), "little") for x in f]
    return whole, sliced(whole, 128), (1 << len(f)) - 1


def _bits(hits: int) -> Iterator[int]:
    while hits:
        low = hits & -hits
        yield low.bit_length() - 1
        hits ^= low


def _forest(f: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links of one bucket; a node reached is not compared again."""
    whole, planes, left = _planes(f)
    full = left
    while left:
        first = (left & -left).bit_length() - 1
        left ^= 1 << first
        queue = [first]
        while queue and left:
            at = queue.pop()
            hits = within(planes, full, whole[at], radius, range(128)) & left
            left ^= hits
            for j in _bits(hits):
                yield at, j
                queue.append(j)


def _apart(f: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """All links of one bucket between different roots."""
    for at in range(0, len(f), _BLOCK):
        _, planes, full = _planes(f[at : at + _BLOCK])
        own: dict[int, int] = {}
        for k, r in enumerate(roots[at : at + _BLOCK].tolist()):
            own[r] = own.get(r, 0) | 1 << k
        for i in range(min(len(f), at + _BLOCK)):
            hits = within(planes, full, int.from_bytes(f[i].tobytes(), "little"), radius, range(128)) & ~own.get(int(roots[i]), 0)
            if i >= at:
                hits = hits >> (i - at + 1) << (i - at + 1)
            for k in _bits(hits):
                yield i, at + k


def _candidates(nodes: DataFrame, keys: list[np.ndarray], radius: int) -> DataFrame:
    """(u, v, far), u < v: nodes(node, root, f0..f3) that share a key and are within the radius, with their distance.

    Where all roots are null a spanning forest of each bucket, else all its pairs of
    different roots.
    """
    place = 1 << np.arange(len(keys[0]), dtype=np.int64)

    @lean
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.stack([c.to_numpy() for c in b.columns[2:]], 1)
            bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(-1, 32), axis=1)
            for k, at in enumerate(keys):
                key = (bits[:, at] @ place) * np.int64(len(keys)) + k
                yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns[:4]], ["key", "node", "root", *_COMPARED])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, node: np.ndarray, root: np.ndarray, whole: bool, f: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            cuts = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1, [len(key)]])
            sizes = np.diff(cuts)
            large = np.repeat(sizes > _SMALL, sizes)
            for a, z in zip(cuts[:-1][sizes > _SMALL].tolist(), cuts[1:][sizes > _SMALL].tolist()):
                out += [(a + i, a + j) for i, j in (_apart(f[a:z], root[a:z], radius) if whole else _forest(f[a:z], radius))]
            found: dict[int, int] = {}

            def top(i: int) -> int:
                while found.get(i, i) != i:
                    i = found[i]
                return i

            first = np.repeat(cuts[:-1], sizes)
            place_in = np.arange(len(key)) - first
            for d in range(min(_SMALL, len(key))):
                # from the least node on, so that the forests of several keys have their links in common
                j = np.nonzero((place_in > d) & ~large)[0]
                if not len(j):
                    break
                i = first[j] + d
                near = _distance(f[i], f[j]) <= radius
                for i, j in zip(i[near].tolist(), j[near].tolist()):
                    if whole:
                        if root[i] != root[j]:
                            out.append((i, j))
                    elif (x := top(i)) != (y := top(j)):
                        found[max(x, y)] = min(x, y)
                        out.append((i, j))
            at = np.array(out, int).reshape(-1, 2)
            u, v = node[at[:, 0]], node[at[:, 1]]
            far = _distance(f[at[:, 0]], f[at[:, 1]])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64()), pa.array(far, pa.int32())], ["u", "v", "far"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            key = b.column(0).to_numpy()
            if rows < 50_000 or key[0] == key[-1]:
                continue
            last = int(np.searchsorted(key, key[-1]))
            held[-1] = b.slice(0, last)
            yield links(*_columns(held))
            held, rows = [b.slice(last)], b.num_rows - last
        if held:
            yield links(*_columns(held))

    kinds = "node long, root long, " + ", ".join(f"{c} long" for c in _COMPARED)
    rows = nodes.select("node", "root", *_F).mapInArrow(keyed, "key long, " + kinds)
    dealt = rows.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "u long, v long, far int").distinct()


def _columns(held: list[pa.RecordBatch]) -> tuple:
    t = pa.Table.from_batches(held)
    root = t.column("root")
    f = np.stack([t.column(c).to_numpy() for c in _COMPARED], 1)
    return t.column("key").to_numpy(), t.column("node").to_numpy(), root.fill_null(-1).to_numpy(), root.null_count == 0, f


def _likely(ends: DataFrame) -> Callable[[Column], Column]:
    """A test of nodes by a bit map of the hashes of ends(node): true for all of those and about one in ten others."""
    size = 1 << max(10, min(28, (8 * max(1, ends.count())).bit_length()))
    at = F.pmod(F.xxhash64("node"), F.lit(size))
    words = ends.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("b")).toArrow()
    held = np.zeros(size >> 6, np.int64)
    held[words.column(0).to_numpy()] = words.column(1).to_numpy()
    bits = held.tobytes()

    @F.pandas_udf("boolean")
    def hit(at: pd.Series) -> pd.Series:
        h = at.to_numpy()
        return pd.Series((np.frombuffer(bits, np.uint64)[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return lambda node: hit(F.pmod(F.xxhash64(node), F.lit(size)))


def _wanted(texts: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The rows of texts(node, text) whose node is in pairs(u, v), of which there are n ends at most; few others are dealt out."""
    ends = staged(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "simhash-ends", n)
    return staged(texts.where(_likely(ends)(F.col("node"))).join(ends, "node", "left_semi"), "simhash-texts")


def _without(rows: DataFrame, left_out: DataFrame) -> DataFrame:
    """rows less those whose uid is in left_out(node); only rows that may be are dealt out."""
    likely = _likely(left_out)
    maybe = rows.where(likely(F.col("uid"))).join(left_out.withColumnRenamed("node", "uid"), "uid", "left_anti")
    return rows.where(~likely(F.col("uid"))).unionByName(maybe)


def _alike(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs(u, v) whose texts(node, text) have a shingle Jaccard of at least ``least``."""
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("p")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("q")), "v")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0

        def shingles(node: int, text: pa.StringScalar) -> np.ndarray:
            nonlocal held
            x = known.get(node)
            if x is None:
                if held > _HELD:
                    known.clear()
                    held = 0
                x = known[node] = _shingles(text.as_py(), width)
                held += len(x) + 64
            return x

        for b in batches:
            keep = []
            for u, v, p, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                x, y = shingles(u, p), shingles(v, q)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= least * (len(x) + len(y) - same))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "p", "q").mapInArrow(run, "u long, v long")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of pairs(u, v, far) the nearest of each node."""
    ends = pairs.select("u", "v", "far").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "far"))
    best = ends.groupBy("u").agg(F.min(F.struct("far", "v")).alias("b")).select("u", F.col("b.v").alias("v"))
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs(u, v) whose ends are not in one class of roots(node, root)."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    rows = pairs.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    return rows.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")


def one_of_each(docs: DataFrame, text_col: str = "text", width: int = 5, radius: int = RADIUS_128, least: float = 0.8) -> DataFrame:
    """The rows left when of each near-duplicate class the first stays, all columns kept.

    Linked are texts whose sets of shingles have a Jaccard of at least ``least``, computed
    exactly, for pairs whose 256-bit fingerprints share a key of ``key_bits`` and are within
    the radius in 128 bits. Each bucket gives a spanning forest of candidates. Of these each text's
    nearest is confirmed first, then all those between classes found so far; where not all
    texts of a candidate group are one class then, a second search compares all pairs of its classes.
    Null and empty texts are one class; texts of any length are compared whole; rows may
    repeat; ids are not used, so they may be null; columns may have any names; no rows give no rows.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    held = staged(numbered(docs).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    texts = held.select(F.col("uid").alias("node"), F.col(f"c{at}").cast("string").alias("text"))
    nodes = staged(_nodes(texts.withColumnRenamed("node", "uid"), width), "simhash-nodes")
    n, rows = nodes.count(), held.count()
    keys = key_bits(n)
    pairs = staged(_candidates(nodes.withColumn("root", F.lit(None).cast("long")), keys, radius), "simhash-pairs", 4 * n)
    texts = _wanted(texts, pairs, n)
    tried = staged(_likeliest(pairs), "simhash-tried", n)
    near = staged(_alike(tried, texts, width, least), "simhash-near", n, apart=True)
    roots = connected_components(near, n)
    others = _between(pairs.join(tried, ["u", "v"], "left_anti"), roots)
    roots = extended(roots, staged(_alike(others, texts, width, least), "simhash-near", n, apart=True), n)
    maybe = connected_components(pairs, n).withColumnRenamed("root", "group")
    open_ = staged(maybe.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-open", n)
    split = open_.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("group")
    rest = nodes.join(open_.join(split, "group").select("node", "root"), "node")
    more = staged(_candidates(rest, keys, radius).join(pairs, ["u", "v"], "left_anti"), "simhash-more", 4 * n)
    roots = extended(roots, staged(_alike(more, texts, width, least), "simhash-near", n, apart=True), n)
    first = nodes.select("node").join(roots.where("node <> root").select("node"), "node", "left_anti")
    left_out = staged(held.select(F.col("uid").alias("node")).join(first, "node", "left_anti"), "simhash-left-out", rows)
    return _without(held, left_out).select(*(f"c{k}" for k in range(len(names)))).toDF(*names)
