"""Blockwise suffix sorting with a difference cover, and removal of repeats.

Any two positions of a text have an offset below 31 at which both fall in the
cover sample. The sample's suffixes are ranked once per text buffer; the other
suffixes are sorted one bucket at a time by their first 32 bytes, and ties of any
length are settled by comparing two sample ranks. No bucket needs more memory
than its own positions.

Distribution: equal windows have equal marks (``repeats``), so suffixes are
dealt by mark. Regions that are equal as a whole are one row before any sorting, as all
their windows repeat; of the rest only regions whose mark has another region can repeat, and
those are sorted. The windows of a mark with many regions are dealt further by a second mark,
under another hash, so they spread over many tasks and equal ones still meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seamlode.llm.common import lean, numbered, open_store, partitions, staged
from seamlode.llm.repeats import regions, second_marks

# A perfect difference cover, every residue mod 31 is a difference of two of these.
COVER, PERIOD = (0, 1, 3, 8, 12, 18), 31
_PREFIX = 32
CROWDED = 2_000
_BUFFER = 1 << 20
_SORTED = 100_000

_DELTA = np.zeros((PERIOD, PERIOD), np.int64)
for _i in range(PERIOD):
    for _j in range(PERIOD):
        _DELTA[_i, _j] = min((d - _i) % PERIOD for d in COVER if (d - _i + _j) % PERIOD in COVER)


class SuffixBlocks:
    """Suffix order of chosen positions of a buffer, exact to at least ``depth`` bytes."""

    def __init__(self, raw: bytes, depth: int = 200):
        self.size, self.depth = len(raw), depth
        self.data = np.frombuffer(raw + bytes(depth + 8 * PERIOD), np.uint8)
        self.view = np.lib.stride_tricks.sliding_window_view(self.data, 8)
        at = np.arange(len(raw))
        sample = at[np.isin(at % PERIOD, COVER)]
        self.rank = np.zeros(len(raw) + 4 * PERIOD + 2 * depth, np.int64)
        if len(sample):
            keys = [self.word(sample, k) for k in range(24, -1, -8)]
            order = np.lexsort(keys)
            self.rank[sample] = self._dense(order, keys)
            step = PERIOD
            while step < depth + PERIOD:
                pair = self.rank[sample] * (len(sample) + 2) + self.rank[sample + step]
                self.rank[sample] = np.unique(pair, return_inverse=True)[1] + 1
                step *= 2

    def word(self, at: np.ndarray, offset: int) -> np.ndarray:
        return np.ascontiguousarray(self.view[at + offset]).view(">u8").ravel().astype(np.uint64)

    @staticmethod
    def _dense(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(order), bool)
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new) + 1
        return out

    def sort(self, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of the positions, bucket by bucket, and for each the tie class of its prefix."""
        keys = [*(self.word(at, k) for k in range(24, -1, -8)), bucket]
        order = np.lexsort(keys)
        tie = self._dense(order, keys)[order]
        self._settle(at, order, tie.copy())
        return order, tie

    def _settle(self, at: np.ndarray, order: np.ndarray, group: np.ndarray) -> None:
        """Three-way partition of every tied group at once, by cover-sample ranks."""
        live = np.arange(len(order))
        while len(live):
            g = group[live]
            edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[edge, len(g)])
            many = np.repeat(size > 1, size)
            if not many.all():
                live = live[many]
                continue
            here = at[order[live]]
            pivot = np.repeat(here[edge + size // 2], size)
            d = _DELTA[here % PERIOD, pivot % PERIOD]
            side = np.sign(self.rank[here + d] - self.rank[pivot + d]) + 1
            own = np.repeat(np.arange(len(edge)), size) * 3
            moved = np.argsort(own + side, kind="stable")
            order[live] = order[live][moved]
            side = side[moved]
            group[live] = own + side
            live = live[side != 1]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the ``depth`` bytes at a and b are equal, given that the first 32 are."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        for k in range(_PREFIX, self.depth, 8):
            k = min(k, self.depth - 8)
            live = live[self.word(a[live], k) == self.word(b[live], k)]
            if not len(live):
                break
        out[:] = False
        out[live] = True
        return out


def repeated_starts(raw: bytes, at: np.ndarray, bucket: np.ndarray, width: int = 200) -> np.ndarray:
    """For each position, whether its window of ``width`` bytes equals another's of its bucket."""
    blocks, out = SuffixBlocks(raw, width), np.zeros(len(at), bool)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() + [len(at)]
    first = 0
    for k in range(1, len(edge)):
        if edge[k] - edge[first] < _SORTED and k + 1 < len(edge):
            continue
        part = slice(edge[first], edge[k])
        order, tie = blocks.sort(at[part], bucket[part])
        here = at[part][order]
        pair = np.flatnonzero(tie[1:] == tie[:-1])
        pair = pair[blocks.same(here[pair], here[pair + 1])]
        hit = np.zeros(len(here), bool)
        hit[pair] = hit[pair + 1] = True
        out[np.arange(part.start, part.stop)[order]] = hit
        first = k
    return out


def _more(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def _marked(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """Every row with a number, its text compressed, and its regions; docs has no names of one underscore and letters."""
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*kept, F.col(text_col).cast("string"))
    schema = rows.drop(text_col).schema
    schema = _more(schema, "_uid long, _z binary, _mark array<long>, _hash array<long>, _first array<long>, _starts array<int>, _twice array<boolean>")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, squeeze = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=9).compress
        types = [pa.int64(), pa.binary(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b, out = whole.slice(at, 256), []
                for t in b.column(len(kept)):
                    raw = (t.as_py() or "").encode()
                    out.append((uid, squeeze(raw), *(zip(*regions(raw, width)) if len(raw) >= width else [()] * 5)))
                    uid += 1
                cols = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *cols], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _parts(marked: DataFrame) -> DataFrame:
    """(part, path) of the staged files: rows of a task of ``_marked`` are in one file."""
    return marked.select(F.shiftright("_uid", 33).alias("part"), F.col("_metadata.file_path").alias("path")).distinct()


def _by_part(rows: DataFrame) -> DataFrame:
    """rows(uid, ...) -> (part, rows): what is known of the rows of each file; no more than the file's own size allows."""
    return rows.groupBy(F.shiftright("uid", 33).alias("part")).agg(F.collect_list(F.struct("*")).alias("rows"))


def _read(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a staged file, from whichever store holds it."""
    store, place = open_store(path)
    with store.open_input_file(place) as source:
        yield from pq.ParquetFile(source).iter_batches(512, columns=columns)


def _contested(found: DataFrame, width: int) -> DataFrame:
    """(uid, first, starts): runs of repeated window starts in regions that occur once.

    found: (path, rows): a staged file and of its rows (uid, mark, crowd, first, starts, once).
    """

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Region texts; those of a crowded mark cut where the second mark changes."""
        grow = zstandard.ZstdDecompressor().decompress
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        names = ["mark", "part", "uid", "first", "text", "once"]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names)

        def texts_of(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[dict]]]:
            for path, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                wanted: dict[int, list[dict]] = {}
                for w in known:
                    wanted.setdefault(w["uid"], []).append(w)
                for part in _read(path, ["_uid", "_z"]):
                    for k, uid in enumerate(part.column(0).to_pylist()):
                        if uid in wanted:
                            yield uid, part.column(1)[k].as_py(), wanted[uid]

        for b in batches:
            rows, held = [], 0
            for uid, z, want in texts_of(b):
                raw = grow(z)
                for w in want:
                    a, n, parts = w["first"], w["starts"], -(-w["crowd"] // CROWDED)
                    runs = [(0, n, 0)]
                    if parts > 1:
                        own = (second_marks(raw[a : a + n + width - 1], width) % np.uint64(parts)).astype(int)
                        edge = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n]
                        runs = [(x, y, int(own[x])) for x, y in zip(edge, edge[1:])]
                    for x, y, part in runs:
                        text = raw[a + x : a + y + width - 1]
                        rows.append((w["mark"], part, uid, a + x, text, w["once"]))
                        held += len(text)
                if held > _BUFFER:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)

    texts = found.mapInArrow(cut, "mark long, part int, uid long, first long, text binary, once boolean")
    texts = texts.repartition(partitions(found.sparkSession), "mark", "part").sortWithinPartitions("mark", "part", "uid", "first")

    @lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            if rows:
                raw, place, at, bucket, n = [], 0, [], [], -1
                last = None
                for mark, part, _, _, text, _ in rows:
                    if (mark, part) != last:
                        last, n = (mark, part), n + 1
                    starts = len(text) - width + 1
                    at.append(place + np.arange(starts))
                    bucket.append(np.full(starts, n))
                    raw.append(text)
                    place += len(text)
                hit = repeated_starts(b"".join(raw), np.concatenate(at), np.concatenate(bucket), width)
                done = 0
                for _, _, uid, first, text, once in rows:
                    own = np.flatnonzero(hit[done : done + len(text) - width + 1])
                    done += len(text) - width + 1
                    if once and len(own):
                        cuts = np.flatnonzero(np.diff(own) != 1) + 1
                        for run in np.split(own, cuts):
                            out.append((uid, first + int(run[0]), len(run)))
            types = [pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, types)], ["uid", "first", "starts"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size > _BUFFER and row[:2] != held[-1][:2]:
                    yield close(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        yield close(held)

    return texts.mapInArrow(judge, "uid long, first long, starts int")


def _cell() -> Column:
    """The word, of 2**20 of 64 bits each, in which a region's bit stands: 16 MB at most to broadcast.

    The bits spare regions that occur once a shuffle; an exact join follows.
    """
    return F.shiftright(F.xxhash64("mark", "hash").bitwiseAND(F.lit((1 << 26) - 1)), 6)


def _bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64("mark", "hash").bitwiseAND(F.lit(63)).cast("int"))


def _merged(windows: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows."""
    out: list[list[int]] = []
    for a, n in sorted(windows):
        z = a + n - 1 + width
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def _kept_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a character that a span covers in part stays."""
    out, at = [], 0
    for a, z in spans:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        out.append(raw[at:a])
        at = z
    return b"".join([*out, raw[at:]]).decode()


def _removed(docs: DataFrame, text_col: str, width: int, text: bool) -> DataFrame:
    """docs has plain names. All columns but the text, then _bytes, _removed, _spans, _sha256 and with ``text`` the text left as _kept."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != text_col]
    marked = staged(_marked(docs, text_col, width), "marked")
    pieces = marked.select("_uid", F.explode(F.arrays_zip("_mark", "_hash", "_first", "_starts", "_twice")).alias("r"))
    pieces = pieces.select(F.col("_uid").alias("uid"), F.col("r._mark").alias("mark"), F.col("r._hash").alias("hash"), F.col("r._first").alias("first"), F.col("r._starts").alias("starts"), F.col("r._twice").alias("twice"))
    # one row a different region: how often, and one place where it stands
    different = staged(
        pieces.groupBy("mark", "hash").agg(F.count("*").alias("n"), F.min(F.struct("uid", "first")).alias("place"), F.max("starts").alias("starts"), F.max("twice").alias("twice")), "regions"
    )
    crowds = different.groupBy("mark").agg(F.count("*").alias("crowd"), F.max(F.col("twice") & (F.col("n") == 1)).alias("own"))
    crowds = crowds.where("crowd > 1 or own").select("mark", "crowd")
    wanted = different.join(crowds, "mark").where("crowd > 1 or (twice and n = 1)").select("place.uid", "mark", "crowd", "place.first", "starts", (F.col("n") == 1).alias("once"))
    files, many = _parts(marked), 4 * partitions(spark)
    contested = _contested(files.join(_by_part(wanted), "part").select("path", "rows"), width)
    often = different.where("n > 1").select("mark", "hash")
    bits = often.groupBy(_cell().alias("cell")).agg(F.bit_or(_bit()).alias("bits"))
    likely = pieces.join(F.broadcast(bits), _cell() == F.col("cell")).where(F.col("bits").bitwiseAND(_bit()) != 0).drop("cell", "bits")
    whole = likely.join(often, ["mark", "hash"], "left_semi").select("uid", "first", "starts")
    # a row stands for a whole file here, so rows are dealt out evenly rather than by their own few bytes
    joined = files.join(_by_part(whole.unionByName(contested)), "part", "left").select("part", "path", "rows").repartition(many, "part").drop("part")
    schema = _more(docs.drop(text_col).schema, "_bytes long, _removed long, _spans long, _sha256 string" + ", _kept string" * text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + text]
        target = to_arrow_schema(schema)
        for b in batches:
            for path, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans: dict[int, list[tuple[int, int]]] = {}
                for x in known or []:
                    spans.setdefault(x["uid"], []).append((x["first"], x["starts"]))
                for part in _read(path, [*kept, "_uid", "_z"]):
                    out = []
                    for uid, z in zip(part.column("_uid").to_pylist(), part.column("_z").to_pylist()):
                        raw = grow(z)
                        gone = _merged(spans.get(uid, []), width)
                        ends = [0, *(z for _, z in gone)]
                        left = b"".join(raw[x:y] for x, y in zip(ends, [*(a for a, _ in gone), len(raw)]))
                        out.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), *([_kept_text(raw, gone)] * text)))
                    cols = [*(part.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(zip(*out), types))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target)], names=target.names)

    return joined.mapInArrow(run, schema)


OUTPUTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = 200, text: bool = False) -> DataFrame:
    """Each row without the bytes covered by a ``width``-byte string that also starts anywhere else.

    Gives all columns but the text, then n_bytes, n_removed, n_spans and kept_sha256, and with
    ``text`` the text left, kept_text, in whose place a character covered in part stays whole; an input
    column of one of these names is left out. Strings are judged on the input; matches never cross
    rows; texts of any length are taken whole; a null text is empty; repeated rows repeat each
    other; ids are not used. No rows give no rows.
    """
    added = OUTPUTS[: 4 + text]
    docs = docs.drop(*(c for c in docs.columns if c in added and c != text_col))
    names, at = docs.columns, docs.columns.index(text_col)
    left = _removed(numbered(docs), f"c{at}", width, text)
    return left.toDF(*(c for c in names if c != text_col), *added)


def without_repeats(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", width: int = 200) -> DataFrame:
    """The rows with the text left in the place of the text, and its length in characters in ``chars_col`` if there is one; cases as in ``remove_repeats``; columns may have any names."""
    names, at = docs.columns, docs.columns.index(text_col)
    left = _removed(numbered(docs), f"c{at}", width, True)
    kind = dict(docs.dtypes)
    found = [F.col("_kept") if c == text_col else F.length("_kept").cast(kind[c]) if c == chars_col else F.col(f"c{k}") for k, c in enumerate(names)]
    return left.select(*(c.alias(f"c{k}") for k, c in enumerate(found))).toDF(*names)
