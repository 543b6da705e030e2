"""Copies of images by local descriptors.

Corners are the strongest responses within ``SPREAD`` pixels at each of several scales, so
a crop keeps the corners of what it shows, and an image has as many as its area holds. Each
gets an orientation by the intensity centroid of its patch, and 256 binary tests turned by
that orientation describe it.

Descriptors meet in Hamming tables: a table's key is a choice of their bits, longer and
with more tables as the corpus grows (``key_bits``). Two images of which at least two corners
each meet, and are near in 64 further bits, are a candidate pair. For each candidate all
corners of both are compared, and the images are copies if matches of at least ``AGREE``
distinct places of either, and of as many as ``SHARE`` of all matches, agree on one turn, scale and shift.

Images with equal pixels are one row before any table. The rest is done twice. First, in
a bucket sorted by image, each corner meets the ``NEXT`` before it: the work is linear in
the rows, and most copies of a large group are joined through one another. Then
every corner meets those of its bucket whose images are not in its image's class: the
largest class of a bucket isn't compared with itself, and buckets of one class not at
all. Crowded buckets are cut into parts of about ``CROWD`` corners, and each two parts
meet in a cell of their own. This second pass grows with the square of a bucket only
where it holds many images of different classes that look alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamlode.llm.common import drop_staged, partitions, staged
from seamlode.llm.components import connected_components, extended

SCALES = (1.0, 0.84, 0.71, 0.595, 0.5)
SPREAD, LEAST_RESPONSE = 4, 1000.0
PATCH, SMOOTH = 10, 2
BITS, TURNS = 256, 32
#: Of 256 bits in a match, of 64 bits in a candidate.
NEAR, NEAR_64 = 36, 16
NEXT = 3
CROWD = 1024
AGREE, SHARE = 5, 0.25
#: A pair of corners that differ in the share ``MISS`` of their bits shares a key with probability ``RECALL``.
MISS, RECALL = 0.1, 0.16
_SMALL = 32
_EDGE = PATCH + SMOOTH
_PIXELS = 1 << 21

CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "u1"), ("turn", "u1"), ("d", "u1", (BITS // 8,))])

_rng = np.random.default_rng(20)
_PATTERN = np.clip(np.round(_rng.normal(0, PATCH / 2.2, (BITS, 4))), -PATCH, PATCH)
_angle = np.arange(TURNS) * 2 * np.pi / TURNS
_ROTATED = np.stack([
    np.round(np.stack([_PATTERN[:, 0::2] * np.cos(a) - _PATTERN[:, 1::2] * np.sin(a), _PATTERN[:, 0::2] * np.sin(a) + _PATTERN[:, 1::2] * np.cos(a)], -1)).astype(int)
    for a in _angle
])  # turn, test, end, (x, y)
_gy, _gx = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
_DISC = (_gx**2 + _gy**2) <= PATCH**2


def _resized(images: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear, over the last two axes."""
    if scale == 1.0:
        return images
    h, w = (max(1, int(round(n * scale))) for n in images.shape[-2:])
    y, x = (np.arange(h) + 0.5) / scale - 0.5, (np.arange(w) + 0.5) / scale - 0.5
    y, x = np.clip(y, 0, images.shape[-2] - 1), np.clip(x, 0, images.shape[-1] - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, images.shape[-2] - 2)), np.minimum(x.astype(int), max(0, images.shape[-1] - 2))
    y1, x1 = np.minimum(y0 + 1, images.shape[-2] - 1), np.minimum(x0 + 1, images.shape[-1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    upper, lower = images[..., y0, :], images[..., y1, :]
    top = upper[..., x0] * (1 - fx) + upper[..., x1] * fx
    return top * (1 - fy) + (lower[..., x0] * (1 - fx) + lower[..., x1] * fx) * fy


def _cut(axis: int, part: slice) -> tuple:
    return (..., part) if axis == -1 else (..., part, slice(None))


def _mean(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1; the edge pixels go on outside."""
    for axis in (-1, -2):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        wide, n = np.pad(a, pad, mode="edge"), a.shape[axis]
        a = wide[_cut(axis, slice(0, n))].copy()
        for k in range(1, 2 * r + 1):
            a += wide[_cut(axis, slice(k, k + n))]
        a /= 2 * r + 1
    return a


def _largest(a: np.ndarray, r: int) -> np.ndarray:
    """Largest value within r (a power of two) of each pixel, along both axes."""
    for axis in (-1, -2):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (r, r)
        m, size = np.pad(a, pad, constant_values=-np.inf), 1
        while size < 2 * r:
            m = np.maximum(m[_cut(axis, slice(None, -size))], m[_cut(axis, slice(size, None))])
            size *= 2
        a = np.maximum(m[_cut(axis, slice(None, -1))], m[_cut(axis, slice(1, None))])
    return a


def describe(images: np.ndarray) -> list[np.ndarray]:
    """images(n, height, width) -> for each, its corners as ``CORNER`` records, in the pixels of the image."""
    owner, found = [], []
    for level, scale in enumerate(SCALES):
        a = _resized(images.astype(np.float32), scale).astype(np.float32)
        if min(a.shape[1:]) < 2 * _EDGE + 3:
            continue
        soft = _mean(a, 1)
        gy, gx = np.zeros_like(soft), np.zeros_like(soft)
        gy[:, 1:-1], gx[:, :, 1:-1] = soft[:, 2:] - soft[:, :-2], soft[:, :, 2:] - soft[:, :, :-2]
        xx, yy, xy = (_mean(v, 2) * 25 for v in (gx * gx, gy * gy, gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        top = (r > LEAST_RESPONSE) & (r >= _largest(r, SPREAD))
        inner = np.zeros_like(top)
        inner[:, _EDGE:-_EDGE, _EDGE:-_EDGE] = True
        n, y, x = np.nonzero(top & inner)
        soft = _mean(a, SMOOTH)
        for at in range(0, len(n), 8192):
            i, u, v = n[at : at + 8192], x[at : at + 8192], y[at : at + 8192]
            patch = soft[i[:, None, None], v[:, None, None] + _gy, u[:, None, None] + _gx] * _DISC
            turn = np.arctan2((patch * _gy).sum((1, 2)), (patch * _gx).sum((1, 2)))
            turn = np.round(turn / (2 * np.pi) * TURNS).astype(int) % TURNS
            tests = _ROTATED[turn]
            ends = soft[i[:, None, None], np.clip(v[:, None, None] + tests[..., 1], 0, a.shape[1] - 1), np.clip(u[:, None, None] + tests[..., 0], 0, a.shape[2] - 1)]
            rows = np.empty(len(i), CORNER)
            rows["x"], rows["y"], rows["scale"], rows["turn"] = (u + 0.5) / scale - 0.5, (v + 0.5) / scale - 0.5, level, turn
            rows["d"] = np.packbits(ends[..., 0] < ends[..., 1], axis=1)
            owner.append(i)
            found.append(rows)
    if not found:
        return [np.empty(0, CORNER) for _ in images]
    owner, rows = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return np.split(rows[order], np.searchsorted(owner[order], np.arange(1, len(images))))


def _words(d: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(d).view(np.uint64).reshape(len(d), -1)


def _nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest of y, and its distance."""
    at, far = np.empty(len(x), int), np.empty(len(x), int)
    step = max(1, (1 << 20) // max(1, len(y)))
    for k in range(0, len(x), step):
        d = np.bitwise_count(x[k : k + step, None] ^ y[None]).sum(2, dtype=np.int32)
        at[k : k + step] = best = d.argmin(1)
        far[k : k + step] = d[np.arange(len(best)), best]
    return at, far


def _matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of a and b that are each other's nearest (or as near as that), within ``NEAR`` bits."""
    p, q = _words(a["d"]), _words(b["d"])
    to, far = _nearest(p, q)
    _, back = _nearest(q, p)
    i = np.flatnonzero((far <= NEAR) & (far <= back[to]))
    return i, to[i]


def _places(rows: np.ndarray) -> int:
    """Distinct places among corners; those of several scales at one place count once."""
    return len(set(zip((rows["x"] // 4).tolist(), (rows["y"] // 4).tolist())))


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the corners a and b of two images match at ``AGREE`` places, a ``SHARE`` of their matches, under one similarity transform.

    Each match proposes the turn, scale and shift of its two corners. The transform is fitted
    to the matches that follow a proposal, and again to those that follow the fit; counted are
    matches that it takes to within 3 pixels and 2 % of their distance from the middle, and whose own
    turn and scale are within 25 degrees and a factor of 1.5 of it.
    """
    if min(len(a), len(b)) < AGREE:
        return False
    i, j = _matches(a, b)
    if len(i) < AGREE:
        return False
    p, q = a["x"][i] + 1j * a["y"][i].astype(float), b["x"][j] + 1j * b["y"][j].astype(float)
    scales = np.array(SCALES)
    turn = (b["turn"][j].astype(float) - a["turn"][i]) * (2 * np.pi / TURNS)
    by = scales[a["scale"][i]] / scales[b["scale"][j]] * np.exp(1j * turn)
    own = np.log(by)

    def alike(m: np.ndarray) -> np.ndarray:
        off = own - np.log(m)
        return (np.abs(off.real) <= np.log(1.5)) & (np.abs((off.imag + np.pi) % (2 * np.pi) - np.pi) <= np.deg2rad(25))

    loose = np.empty(len(p), int)
    step = max(1, (1 << 20) // len(p))
    for at in range(0, len(p), step):
        part = slice(at, at + step)
        gap = q[None] - q[part, None]
        loose[part] = ((np.abs(gap - by[part, None] * (p[None] - p[part, None])) <= 4 + 0.2 * np.abs(gap)) & alike(by[part, None])).sum(1)
    seen = set()
    for k in np.argsort(-loose, kind="stable").tolist():
        if loose[k] < AGREE:
            break
        near = (np.abs(q - q[k] - by[k] * (p - p[k])) <= 4 + 0.2 * np.abs(q - q[k])) & alike(by[k])
        for _ in range(4):
            if near.sum() < AGREE or near.tobytes() in seen:
                break
            seen.add(near.tobytes())
            u, v = p[near] - p[near].mean(), q[near] - q[near].mean()
            size = (np.abs(u) ** 2).sum()
            m = (np.conj(u) * v).sum() / size if size > 1 else 0
            if not 0.2 <= abs(m) <= 5:
                break
            gap = q - q[near].mean()
            near = (np.abs(gap - m * (p - p[near].mean())) <= 3 + 0.02 * np.abs(gap)) & alike(np.array(m))
            if near.sum() >= AGREE and min(_places(a[i[near]]), _places(b[j[near]])) >= max(AGREE, SHARE * len(i)):
                return True
    return False


def described(images: DataFrame) -> DataFrame:
    """images(id, width, height, pixels) -> (id, same, corners): a digest of the pixels, and all corners as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                same: list[str | None] = [None] * b.num_rows
                corners = [b""] * b.num_rows
                by_shape: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
                for k, (w, h, pixels) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                    if w and h and w > 0 and pixels is not None and len(pixels) == w * h:
                        same[k] = hashlib.sha256(f"{w}x{h}x".encode() + pixels).hexdigest()
                        by_shape.setdefault((h, w), []).append((k, pixels))
                for (h, w), own in by_shape.items():
                    step = max(1, _PIXELS // (h * w))
                    for k in range(0, len(own), step):
                        part = own[k : k + step]
                        stack = np.stack([np.frombuffer(p, np.uint8).reshape(h, w) for _, p in part])
                        for (row, _), got in zip(part, describe(stack)):
                            corners[row] = got.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.string()), pa.array(corners, pa.binary())], ["id", "same", "corners"])

    return images.select("id", "width", "height", "pixels").mapInArrow(run, "id long, same string, corners binary")


# -- candidates ------------------------------------------------------------------


def key_bits(n: int) -> list[np.ndarray]:
    """The bits of each table's key for n corners: more and longer keys as n grows, so that buckets stay small.

    Bits of one descriptor depend on one another, so a key has 13 bits more than would number the corners.
    """
    size = min(60, n.bit_length() + 13)
    count = max(4, int(np.ceil(np.log(1 - RECALL) / np.log(1 - (1 - MISS) ** size))))
    rng = np.random.default_rng(21)
    return [rng.choice(BITS, size, replace=False) for _ in range(count)]


def _keyed(firsts: DataFrame, keys: list[np.ndarray]) -> DataFrame:
    """firsts(image, corners) -> (key, image, bits): each corner in each table, with 64 of its bits."""
    place = 1 << np.arange(len(keys[0]), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                held = [np.frombuffer(c, CORNER) for c in b.column(1).to_pylist()]
                rows = np.concatenate(held)
                image = np.repeat(b.column(0).to_numpy(), [len(h) for h in held])
                for start in range(0, len(rows), 1 << 16):
                    d = rows["d"][start : start + (1 << 16)]
                    bits, near = np.unpackbits(d, axis=1), _words(d)[:, 0].view(np.int64)
                    for k, own in enumerate(keys):
                        key = (bits[:, own] @ place) * np.int64(len(keys)) + k
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(image[start : start + len(d)]), pa.array(near)], ["key", "image", "bits"])

    return firsts.select("image", "corners").mapInArrow(run, "key long, image long, bits long")


def _shared(firsts: DataFrame, keys: list[np.ndarray]) -> DataFrame:
    """(key, image, bits, n): rows of ``_keyed`` whose bucket holds more than one, with its size."""
    keyed = _keyed(firsts, keys)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(counts, "key")


def _cells(rows: DataFrame, reach: int | None) -> DataFrame:
    """(a, b, p, q): near corners of images of different roots that meet in a cell, a < b.

    rows: (key, i, kind, j, half, image, root, bits); (key, i, kind, j) is the cell. Compared are corners of different
    halves, or all if kind is 0; with ``reach`` only those so many places apart.
    """
    dealt = rows.repartition(partitions(rows.sparkSession), "key", "i", "kind", "j").sortWithinPartitions("key", "i", "kind", "j", "image", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: pa.Table) -> pa.RecordBatch:
            key, i, kind, j, half, image, root, bits = (t.column(c).to_numpy() for c in ("key", "i", "kind", "j", "half", "image", "root", "bits"))
            new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (kind[1:] != kind[:-1]) | (j[1:] != j[:-1])
            cell = np.concatenate([[0], np.cumsum(new)])
            near = bits.view(np.uint64)
            out: list[tuple[np.ndarray, np.ndarray]] = []

            def keep(x: np.ndarray, y: np.ndarray) -> None:
                ok = (root[x] != root[y]) & ((kind[x] == 0) | (half[x] != half[y]))
                x, y = x[ok], y[ok]
                ok = np.bitwise_count(near[x] ^ near[y]) <= NEAR_64
                out.append((x[ok], y[ok]))

            sizes = np.bincount(cell)
            large = sizes[cell] > _SMALL if reach is None else np.zeros(len(cell), bool)
            for d in range(1, min(len(cell), _SMALL if reach is None else reach + 1)):
                x = np.flatnonzero((cell[d:] == cell[:-d]) & ~large[d:])
                if not len(x):
                    break
                keep(x, x + d)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for c in np.flatnonzero(sizes > _SMALL).tolist() if reach is None else []:
                at = np.arange(starts[c], starts[c + 1])
                for k in range(len(at) - 1):
                    keep(np.full(len(at) - k - 1, at[k]), at[k + 1 :])
            x, y = (np.concatenate([o[k] for o in out]) if out else np.empty(0, int) for k in (0, 1))
            turned = image[x] > image[y]
            x, y = np.where(turned, y, x), np.where(turned, x, y)
            return pa.RecordBatch.from_arrays([pa.array(image[x]), pa.array(image[y]), pa.array(bits[x]), pa.array(bits[y])], ["a", "b", "p", "q"])

        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < 40_000:
                continue
            t = pa.Table.from_batches(held)
            last = [t.column(c).to_numpy() for c in ("key", "i", "kind", "j")]
            ends = np.flatnonzero(np.any([c != c[-1] for c in last], axis=0))
            if not len(ends):
                continue
            cut = int(ends[-1]) + 1
            yield links(t.slice(0, cut))
            held, n = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if n:
            yield links(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long, p long, q long")


def _chained(shared: DataFrame) -> DataFrame:
    """Candidates of the first pass: each corner with the ``NEXT`` before it in its part of the bucket."""
    part = F.pmod(F.xxhash64("image"), F.ceil(F.col("n") / CROWD)).cast("int")
    zero = F.lit(0)
    return _cells(shared.select("key", part.alias("i"), zero.alias("kind"), zero.alias("j"), zero.alias("half"), "image", F.col("image").alias("root"), "bits"), NEXT)


def _apart(shared: DataFrame) -> DataFrame:
    """Candidates of the second pass: all corners of a bucket of different roots.

    The rows of a bucket's largest class are one side, cut into parts, and the others another:
    cells are each two parts of the others, and each part of the others with each of the largest class.
    """
    sizes = shared.groupBy("key", "root").agg(F.count("*").alias("own"))
    most = sizes.groupBy("key").agg(F.max(F.struct("own", "root")).alias("m"), F.sum("own").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    most = most.select("key", F.col("m.root").alias("big"), F.ceil(F.col("m.own") / CROWD).cast("int").alias("pb"), F.ceil((F.col("n") - F.col("m.own")) / CROWD).cast("int").alias("po"))
    rows = shared.select("key", "image", "root", "bits").join(most, "key")
    mine = F.pmod(F.xxhash64("image"), F.when(F.col("root") == F.col("big"), F.col("pb")).otherwise(F.col("po"))).cast("int")
    rows = rows.withColumn("mine", mine)

    def cell(i, kind, j, half):
        return F.struct(i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"), F.lit(half).alias("half"))

    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    m = F.col("mine")
    large = F.transform(upto("po"), lambda k: cell(k, 2, m, 1))
    other = F.concat(
        F.transform(upto("pb"), lambda k: cell(m, 2, k, 0)), F.array(cell(m, 0, m, 0)),
        F.transform(F.filter(upto("po"), lambda k: k > m), lambda k: cell(m, 1, k, 0)),
        F.transform(F.filter(upto("po"), lambda k: k < m), lambda k: cell(k, 1, m, 1)),
    )
    rows = rows.select("key", "image", "root", "bits", F.explode(F.when(F.col("root") == F.col("big"), large).otherwise(other)).alias("c"))
    return _cells(rows.select("key", "c.i", "c.kind", "c.j", "c.half", "image", "root", "bits"), None)


def _pairs(found: DataFrame) -> DataFrame:
    """(a, b): images of which at least two corners each met."""
    return found.groupBy("a", "b").agg(F.count_distinct("p").alias("m"), F.count_distinct("q").alias("n")).where("m > 1 and n > 1").select("a", "b")


def _agreeing(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(u, v): the pairs(a, b) that are copies by all their corners."""
    ends = pairs.select(F.col("a").alias("image")).unionByName(pairs.select(F.col("b").alias("image"))).distinct()
    known = staged(firsts.select("image", "corners").join(ends, "image"), "image-corners")
    both = pairs.join(known.select(F.col("image").alias("a"), F.col("corners").alias("x")), "a").join(known.select(F.col("image").alias("b"), F.col("corners").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [agree(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(hit, pa.bool_())).rename_columns(["u", "v"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "u long, v long")


def copies(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(id, n_corners, n_copies, copy_class) of every row of images(id, width, height, pixels).

    copy_class is the smallest id of the images that are copies, directly or
    through others, and n_copies the number of rows of that class, itself included.
    Images of any size are described whole. Rows of no valid pixels (null, or not width *
    height bytes) have no corners and are linked to nothing, each its own class; rows of
    equal pixels and size are one class, whether or not they have corners; repeated
    rows, and several rows of one id, each get a row. A null id counts as no smallest id: the class
    of a row without an id and without copies that have one is null. Other columns are
    ignored, whatever their names; no rows give no rows.
    """
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("pixels").cast("binary").alias("pixels"))
    rows = staged(described(rows).withColumn("uid", F.monotonically_increasing_id()), "images")
    each = rows.where("same is not null").groupBy("same").agg(F.min("id").alias("least"), F.min(F.struct("uid", "corners")).alias("f"), F.count("*").alias("rows"))
    each = staged(each.select("same", "least", F.col("f.uid").alias("image"), F.col("f.corners").alias("corners"), "rows"), "image-each")
    whole_rows, rows = rows, staged(rows.select("id", "same"), "image-ids")
    drop_staged(whole_rows)
    n_corners = (F.length("corners") / CORNER.itemsize).cast("long")
    keys = key_bits(int(each.agg(F.coalesce(F.sum(n_corners), F.lit(0))).first()[0]))
    shared = staged(_shared(each, keys), "image-buckets")
    tried = staged(_pairs(_chained(shared)), "image-tried")
    near = staged(_agreeing(tried, each), "image-near")
    roots = connected_components(near).withColumnRenamed("node", "image")
    apart = shared.join(roots, "image", "left").withColumn("root", F.coalesce("root", "image"))
    rest = staged(_pairs(_apart(apart)).join(tried, ["a", "b"], "left_anti"), "image-rest")
    roots = extended(roots.withColumnRenamed("image", "node"), staged(_agreeing(rest, each), "image-links")).withColumnRenamed("node", "image")
    own = staged(each.select("same", "least", "image", "rows", n_corners.alias("n_corners")).join(roots, "image", "left").withColumn("root", F.coalesce("root", "image")), "image-own")
    whole = own.groupBy("root").agg(F.min("least").alias("copy_class"), F.sum("rows").alias("n_copies"))
    drop_staged(shared, tried, near, rest)
    facts = own.join(whole, "root").select("same", "copy_class", "n_corners", "n_copies")
    return rows.select("id", "same").join(facts, "same", "left").select("id", F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("copy_class", "id").alias("copy_class"))


@cache
def _textures(n: int, side: int) -> np.ndarray:
    """A fixed texture of fine grain for each of n components."""
    return np.stack([_mean(np.random.default_rng([5, k]).normal(size=(side, side)), 1) for k in range(n)])


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 80) -> DataFrame:
    """Vectors as grey images: fixed textures, one a component, added by the components' weights and scaled to their range.

    So every patch of an image depends on all components, and vectors that are nearly equal give images that differ
    by a little noise. A null vector, or one of null or non-finite components only, has null
    pixels; other such components count as zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pixels = []
            for v in b.column(1).to_pylist():
                a = np.array([np.nan if x is None else x for x in v or []], float)
                if not np.isfinite(a).any():
                    pixels.append(None)
                    continue
                a = np.where(np.isfinite(a), a, 0)
                drawn = np.tensordot(a / max(np.abs(a).max(), 1e-300), _textures(len(a), side), 1)
                drawn -= drawn.min()
                pixels.append(np.round(drawn / max(drawn.max(), 1e-300) * 255).astype(np.uint8).tobytes())
            n = [None if p is None else side for p in pixels]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(n, pa.int32()), pa.array(pixels, pa.binary())], ["image_id", "width", "height", "pixels"])

    rows = vectors.select(F.col(id_col).cast("long").alias("image_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "image_id long, width int, height int, pixels binary")
