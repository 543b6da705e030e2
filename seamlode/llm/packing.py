"""Bounded-space best-fit packing of token pieces into sequences.

A packer keeps a fixed number of open bins. Bins are keyed by free space and a
bitset marks which free spaces occur, so the tightest bin that an item fits is
the lowest set bit at or above its length. When a bin must be opened and all are
in use, the fullest one closes first.

Packers run one per partition over pieces dealt by hash; each holds the open bins
only. A packer takes its pieces in hash order, so that long and short ones come
mixed: longest first, bins of long pieces would close before any short piece came
to fill them. A packer gets about ``PIECES`` pieces, so the few bins that end
underfull are a vanishing share at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamlode.llm import tokens
from seamlode.llm.common import give_back, lean, staged

PIECES = 100_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best fit with at most ``space`` open bins of ``size``."""

    def __init__(self, size: int, space: int):
        self.size, self.space, self.open, self.bins = size, space, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0

    def _take(self, free: int) -> int:
        held = self.free[free]
        bin_id = held.pop()
        if not held:
            self.mask ^= 1 << free
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next item; 0 < length <= size."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.space:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            bin_id, free = self.bins, self.size
            self.bins += 1
        left = free - length
        if left:
            self.free[left].append(bin_id)
            self.mask |= 1 << left
            self.open += 1
        return bin_id, self.size - free


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` ids; of a longer document all but the first are full.

    A null text is empty, that is its end id alone; texts of any length are cut whole; null ids and
    repeated rows have pieces like any other; other columns are ignored, whatever their names; no
    rows give no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            give_back()  # what earlier stages and batches took
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 256):
                rows = []
                for doc, enc in zip(ids[at : at + 256], tokens.encode(texts.slice(at, 256).to_pylist(), vocabulary, room=tokens.SMALL)):
                    cuts = [0, *range(len(enc) % size or size, len(enc), size), len(enc)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((doc, k, a, z - a, zlib.crc32(enc[a:z].tobytes())))
                cols = list(zip(*rows)) or [()] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE)


def pack(cut: DataFrame, size: int = 1024, space: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces; repeated rows are packed each, in any order.

    Pieces of null id are packed like any other. Every document has at least its end id, so no
    piece is empty; of the bins that fit equally well the one last left so is taken; no rows give no sequences.
    """
    cut = staged(cut, "pieces")
    n = max(1, -(-cut.count() // PIECES))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    mixed = F.xxhash64(F.lit("order"), *names)  # not the hash that deals them
    dealt = cut.select(*names).repartition(n, *names).sortWithinPartitions(mixed, *names)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, packer = TaskContext.get().partitionId() << 40, BestFit(size, space)
        for b in batches:
            placed = [packer.place(x) for x in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([first + x for x, _ in placed], pa.int64()), pa.array([x for _, x in placed], pa.int64())],
                [*names, "sequence_id", "offset"],
            )

    return dealt.mapInArrow(run, _PIECE + ", sequence_id long, offset long")
