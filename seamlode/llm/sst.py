"""Sorted-string-table shards of token ids, keyed by document id.

Shard: data blocks, then block index, Bloom filter and footer.

* Key: 9 bytes that sort like the id: tag 0 for null, or 1 and the id as
  big-endian 64 bits with its sign bit flipped. Null ids come first.
* Block: zstd over entries and restart points. An entry is the length shared
  with the previous key, the length of the rest, the length of the value
  (varints), the rest of the key, and the value. Every 16th entry is a restart
  and shares nothing, so a block is searched by bisection of its restarts.
* Value: a width byte (2 or 4), then ids as little-endian unsigned integers.
* Index (sparse): per block its last key, offset and size; Bloom filter: 10
  bits a key, 7 probes; footer: offsets, entry and id counts, crc32, magic.

Writers are tasks of a range partitioning by id and, within one id, by a hash of the text. A shard has a name of its
own for each attempt and counts only if the manifest row of its task is committed,
so a lost or repeated task leaves no half-written shard in the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamlode.llm import tokens
from seamlode.llm.common import open_store, partitions, shared_path, staged

MAGIC = b"SMLSST01"
RESTART = 16
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQQI8s")


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) % (1 << 64))


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" + ids.astype("<u2").tobytes()) if small else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Streams ascending keys into one shard."""

    def __init__(self, sink):
        self.sink, self.at, self.crc = sink, 0, 0
        self.entries, self.size, self.restarts, self.n, self.last = [], 0, [], 0, b""
        self.index, self.keys, self.ids = [], [], 0

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(self.size)
        else:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        value = pack_ids(ids)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries.append(entry)
        self.size += len(entry)
        self.n, self.last = self.n + 1, key
        self.keys.append(key)
        self.ids += len(ids)
        if self.size >= BLOCK_BYTES:
            self._block()

    def _block(self) -> None:
        if self.entries:
            raw = b"".join(self.entries) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            data = zstandard.ZstdCompressor(level=1).compress(raw)
            self.index.append((self.last, self.at, len(data)))
            self._put(data)
            self.entries, self.size, self.restarts, self.n = [], 0, [], 0

    def close(self) -> None:
        self._block()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index))
        bloom_at, bits = self.at, max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._put(bytes(bloom))
        self.sink.write(_FOOTER.pack(index_at, bloom_at, self.at, bits, len(self.keys), self.ids, self.crc, MAGIC))
        self.sink.close()


class ShardReader:
    """Looks ids up or scans; reads the footer, index and filter at once and blocks when asked."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        index_at, bloom_at, end, self.bits, self.n_entries, self.n_ids, self.crc, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(index_at)
        raw = source.read(end - index_at)
        self.tail, self.bloom = raw, raw[bloom_at - index_at :]
        self.last_keys, self.blocks, at = [], [], 0
        while at < bloom_at - index_at:
            n, at = _read_varint(raw, at)
            self.last_keys.append(raw[at : at + n])
            self.blocks.append(struct.unpack_from("<QI", raw, at + n))
            at += n + 12

    def _load(self, k: int) -> tuple[bytes, list[int]]:
        at, size = self.blocks[k]
        self.source.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(size))
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        restarts = list(struct.unpack_from(f"<{n}I", raw, len(raw) - 4 - 4 * n))
        return raw[: len(raw) - 4 - 4 * n], restarts

    @staticmethod
    def _walk(body: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All rows in key order; a shard whose bytes do not have the footer's checksum is an error."""
        crc = 0
        for k, (at, size) in enumerate(self.blocks):
            self.source.seek(at)
            crc = zlib.crc32(self.source.read(size), crc)
            for key, value in self._walk(self._load(k)[0], 0):
                yield id_of(key), unpack_ids(value)
        if zlib.crc32(self.tail, crc) != self.crc:
            raise ValueError("the shard is damaged")

    @staticmethod
    def _key_at(body: bytes, at: int) -> bytes:
        """The key of a restart, which shares nothing."""
        _, at = _read_varint(body, at)
        size, at = _read_varint(body, at)
        _, at = _read_varint(body, at)
        return body[at : at + size]

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row of this key, in file order; none if absent."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        found = []
        for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
            body, restarts = self._load(k)
            first = bisect_left(restarts, key, key=lambda r: self._key_at(body, r))
            for held, value in self._walk(body, restarts[max(0, first - 1)]):
                if held > key:
                    return found
                if held == key:
                    found.append(unpack_ids(value))
        return found


def write_shards(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write the shards in ascending id order; returns the manifest.

    Manifest: part, seq (shards in key order), path, n_docs, n_ids. Null texts are
    empty, null ids come first; rows of one id are ordered by a hash of their text and may be in several
    shards; texts of any length are encoded whole; equal rows each have an entry. Other columns
    are ignored, whatever their names; no rows give no shards.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = open_store(folder)
        part, seq, w, made = TaskContext.get().partitionId(), 0, None, []

        def close() -> None:
            w.close()
            made.append((part, seq, name, len(w.keys), w.ids))

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 256):
                for doc, enc in zip(ids[at : at + 256], tokens.encode(texts.slice(at, 256).to_pylist(), vocabulary)):
                    if w is None:
                        store.create_dir(root, recursive=True)
                        name = f"shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                        w = ShardWriter(store.open_output_stream(f"{root}/{name}"))
                    w.add(key_of(doc), enc)
                    if w.at >= SHARD_BYTES:
                        close()
                        w, seq = None, seq + 1
        if w is not None:
            close()
        cols = list(zip(*made)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "seq", "path", "n_docs", "n_ids"])

    made = rows.mapInArrow(run, "part int, seq int, path string, n_docs long, n_ids long")
    return staged(made, "sst-manifest").select("part", "seq", F.concat(F.lit(folder + "/"), "path").alias("path"), "n_docs", "n_ids")


def scan_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents: start counts all ids before, over all shards."""
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    placed = placed.repartition(partitions(manifest.sparkSession), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, place = open_store(path)
                with store.open_input_file(place) as source:
                    docs, starts, ids, held = [], [], [], 0
                    for doc, got in ShardReader(source).scan():
                        docs.append(doc)
                        starts.append(base)
                        ids.append(got)
                        base += len(got)
                        held += len(got)
                        if held > 1 << 20:
                            yield _rows(docs, starts, ids)
                            docs, starts, ids, held = [], [], [], 0
                    yield _rows(docs, starts, ids)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(docs: list, starts: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
        ["doc_id", "start", "n_tokens", "ids_crc32"],
    )


def shard_folder(spark) -> str:
    return shared_path(spark, "sst")
