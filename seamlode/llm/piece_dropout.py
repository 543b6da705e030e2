"""Piece-BPE encoding with seeded merge dropout, and lossless decoding.

Merges are taken from an agenda by score, then from the left. With dropout a
candidate popped from the agenda is skipped if a keyed hash of its place and its merge
falls below the rate. The key is of the document's id and the segment's place in
the document, so every candidate of every use of a word has a draw of its own; without
dropout the result is the model's own.

Spaces become U+2581 and no piece has one after another character, so a text splits
before each run of them into segments that are encoded apart. The agendas of many segments
run side by side as rows of arrays: each step takes the best candidate of every row, draws, and
merges. A cache of bounded size keeps the model's own ids of a segment and the candidates of
its own merges: a use in which none of them is skipped takes those ids, any other runs its
agenda. Characters without a piece, and U+2581 itself, fall back to byte pieces, so that
decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
_CACHE_SEGMENTS = 250_000
_SEGMENT_CHARS = 64
_WIDTHS = (4, 6, 8, 10, 12, 16, 24, _SEGMENT_CHARS)
_ROWS = 1 << 17
_NEVER = 1 << 31
_M, _A, _B = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_models: dict[str, PieceModel] = {}


def skipped(key: int, place: int, merge: int, bound: int) -> bool:
    """Whether the candidate at this place is skipped: a hash of 64 bits falls below the bound."""
    x = (key ^ (place << 32 | merge)) * _A & _M
    return (x ^ x >> 32) * _B & _M < bound


def _skipped(key: np.ndarray, candidate: np.ndarray, bound: int) -> np.ndarray:
    """The same of many; candidate is place << 32 | merge."""
    x = (key ^ candidate) * np.uint64(_A)
    return (x ^ (x >> np.uint64(32))) * np.uint64(_B) < np.uint64(min(bound, _M))


def _keys(key: int, n: int) -> np.ndarray:
    """Keys of the n segments of a text (splitmix64 finaliser)."""
    z = np.uint64(key) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_A)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Flat:
    """Rows of different lengths, end to end."""

    def __init__(self, kind: str):
        self.values, self.ends, self.size = np.empty(1 << 16, kind), [0], 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.values):
            grown = np.empty(max(need, 2 * len(self.values)), self.values.dtype)
            grown[: self.size] = self.values[: self.size]
            self.values = grown
        self.values[self.size : need] = values
        self.ends += (self.size + np.cumsum(lengths)).tolist()
        self.size = need


def _taken(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of rows that start at ``first`` and hold n each."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first - ends + n, n)]


class PieceModel:
    """Pieces, scores and byte pieces of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.cost: dict[str, int] = {}
        self.bytes_of, self.byte_ids = [b""] * n, [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.cost[piece] = i, int(-sp.get_score(i))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self._bytes_of_space = np.array([self.byte_ids[x] for x in SPACE.encode()], "<u4")
        self._tables(n)
        self._forget()

    def _tables(self, n: int) -> None:
        """Symbols: the pieces by id, then characters that occur in pieces only, then one for any other. Merges by pair of symbols."""
        symbol = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbol.setdefault(c, n + len(symbol))
        self.symbols = max(symbol.values()) + 2
        chars = {ord(p): i for p, i in symbol.items() if len(p) == 1}
        self.char = np.full(max(chars) + 2, self.symbols - 1, np.int64)
        self.char[list(chars)] = list(chars.values())
        made = [(symbol[p[:k]] * self.symbols + symbol[p[k:]], i, self.cost[p]) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        code, merged, cost = (np.array(x, np.int64) for x in zip(*made))
        self.slots = 1 << (4 * len(code)).bit_length()
        self.table = np.full((self.slots, 3), -1, np.int64)
        at, left = self._slot(code), np.arange(len(code))
        while len(left):  # open addressing: the first of those that want a free slot gets it
            free = left[self.table[at[left], 0] == -1]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.table[at[won]] = np.stack([code[won], merged[won], cost[won]], 1)
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + (self.table[at[left], 0] != -1)) % self.slots

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.astype(np.uint64) * np.uint64(_A)) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and cost of the merge of each two symbols; cost ``_NEVER`` if there is none."""
        code = a * self.symbols + b
        at = self._slot(code)
        row = self.table[at]
        open_ = np.flatnonzero((row[:, 0] != code) & (row[:, 0] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.slots
            row[open_] = self.table[at[open_]]
            open_ = open_[(row[open_, 0] != code[open_]) & (row[open_, 0] != -1)]
        return row[:, 1], np.where(row[:, 0] == code, row[:, 2], _NEVER)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.letters, self.plain, self.wanted = _Flat("i8"), _Flat("<u4"), _Flat("u8")

    def _agenda(self, sym: np.ndarray, size: np.ndarray, key: np.ndarray | None, bound: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Merge the first ``size`` symbols of every row; sym is overwritten.

        Gives the symbols left, row by row, how many each row has, and without a key
        the candidates taken, in order, as (rows, place << 32 | merge).
        """
        n, width = sym.shape
        at, cols = np.arange(n), np.arange(width)
        after = np.minimum(cols + 1, size[:, None])
        before = np.tile(cols - 1, (n, 1))
        alive = cols < size[:, None]
        cost = np.full(sym.shape, _NEVER, np.int64)
        into = np.zeros(sym.shape, np.int64)
        r, c = np.nonzero(cols < (size - 1)[:, None])
        into[r, c], cost[r, c] = self._merge(sym[r, c], sym[r, c + 1])
        live, trail = at, []
        while len(live):
            k = cost[live].argmin(1)
            least = cost[live, k]
            going = least < _NEVER
            live, k, least = live[going], k[going], least[going]
            candidate = k.astype(np.uint64) << np.uint64(32) | least.astype(np.uint64)
            take, at_k = live, k
            if key is not None:
                skip = _skipped(key[live], candidate, bound)
                cost[live[skip], k[skip]] = _NEVER
                take, at_k = live[~skip], k[~skip]
            else:
                trail.append((live, candidate))
            if not len(take):
                continue
            b = after[take, at_k]
            sym[take, at_k] = into[take, at_k]
            alive[take, b], cost[take, b] = False, _NEVER
            c = after[take, at_k] = after[take, b]
            inner = c < size[take]
            before[take[inner], c[inner]] = at_k[inner]
            cost[take[~inner], at_k[~inner]] = _NEVER
            r, x, y = take[inner], at_k[inner], c[inner]
            into[r, x], cost[r, x] = self._merge(sym[r, x], sym[r, y])
            ahead = before[take, at_k]
            has = ahead >= 0
            r, x, y = take[has], ahead[has], at_k[has]
            into[r, x], cost[r, x] = self._merge(sym[r, x], sym[r, y])
        return sym[alive], alive.sum(1), trail

    def _rows(self, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters of known segments, padded."""
        ends = self._ends["letters"]
        size = ends[word + 1] - ends[word]
        sym = np.zeros((len(word), width), np.int64)
        sym[np.arange(width) < size[:, None]] = _taken(self.letters.values, ends[word], size)
        return sym, size

    def _learn(self, words: list[str]) -> None:
        """Letters, the model's own ids and the candidates of new segments; those that need bytes or are long have no letters."""
        if len(self.known) > _CACHE_SEGMENTS:
            self._forget()
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        flat = self.char[np.minimum(np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), "<u4"), len(self.char) - 1)]
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(size) - size
        odd = (np.add.reduceat(flat >= len(self.bytes_of), starts) > 0) | (size > _SEGMENT_CHARS)
        size = np.where(odd, 0, size)
        self.letters.add(_taken(flat, starts, size), size)
        self._ends = {"letters": np.array(self.letters.ends)}
        ids, counts, taken, n_taken = [], np.zeros(len(words), np.int64), [], np.zeros(len(words), np.int64)
        for low, high in zip((0, *_WIDTHS), _WIDTHS):
            own = np.flatnonzero((size > low) & (size <= high))
            if not len(own):
                continue
            sym, n = self._rows(first + own, high)
            got, left, trail = self._agenda(sym, n, None, 0)
            ids.append((np.repeat(own, left), got))
            counts[own] = left
            if trail:
                rows, candidates = (np.concatenate(x) for x in zip(*trail))
                taken.append((own[rows], candidates))
                n_taken[own] = np.bincount(rows, minlength=len(own))
        for flat_, parts, n in ((self.plain, ids, counts), (self.wanted, taken, n_taken)):
            owner = np.concatenate([o for o, _ in parts]) if parts else np.empty(0, int)
            values = np.concatenate([v for _, v in parts]) if parts else np.empty(0, int)
            flat_.add(values[np.argsort(owner, kind="stable")], n)
        self._ends |= {"plain": np.array(self.plain.ends), "wanted": np.array(self.wanted.ends)}

    def _segments(self, words: list[str], key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments that follow a space each, end to end, and how many each has."""
        bound = int(rate * (1 << 64))
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            if len(self.known) + len(new) > _CACHE_SEGMENTS:
                self._forget()
                new = list(dict.fromkeys(words))
            self._learn(new)
        word = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends = {name: e for name, e in self._ends.items()}
        n, first = (ends["plain"][word + 1] - ends["plain"][word], ends["plain"][word])
        size = ends["letters"][word + 1] - ends["letters"][word]
        wanted = ends["wanted"][word + 1] - ends["wanted"][word]
        hit = _skipped(np.repeat(key, wanted), _taken(self.wanted.values, ends["wanted"][word], wanted), bound) if bound else np.zeros(0, bool)
        again = np.zeros(len(word), bool)
        again[np.repeat(np.arange(len(word)), wanted)[hit] if bound else []] = True
        changed = {}
        for low, high in zip((0, *_WIDTHS), _WIDTHS):
            own = np.flatnonzero(again & (size > low) & (size <= high))
            if len(own):
                sym, m = self._rows(word[own], high)
                got, left, _ = self._agenda(sym, m, key[own], bound)
                changed[high] = own, got, left
        odd = np.flatnonzero(size == 0).tolist()
        plain = {k: np.array(self.segment(SPACE + words[k], int(key[k]), rate), "<u4") for k in odd}
        counts = np.where(again, 0, n)
        for own, _, left in changed.values():
            counts[own] = left
        counts[odd] = [len(plain[k]) for k in odd]
        out = np.empty(int(counts.sum()), "<u4")
        starts = np.cumsum(counts) - counts
        kept = np.flatnonzero(~again & (size > 0))
        out[np.arange(int(counts[kept].sum())) + np.repeat(starts[kept] - (np.cumsum(counts[kept]) - counts[kept]), counts[kept])] = _taken(self.plain.values, first[kept], n[kept])
        for own, got, left in changed.values():
            out[np.arange(len(got)) + np.repeat(starts[own] - (np.cumsum(left) - left), left)] = got
        for k in odd:
            out[starts[k] : starts[k] + counts[k]] = plain[k]
        return out, counts

    def _merged(self, text: str, key: int, bound: int) -> list[str]:
        """The agenda of one segment of any length, as a heap."""
        n = len(text)
        piece = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        cost, agenda = self.cost, []

        def propose(a: int, b: int) -> None:
            both = piece[a] + piece[b]
            c = cost.get(both)
            if c is not None:
                agenda.append((c, a, both)) if not live else heapq.heappush(agenda, (c, a, both))

        live = False
        for a in range(n - 1):
            propose(a, a + 1)
        heapq.heapify(agenda)
        live = True
        while agenda:
            least, a, both = heapq.heappop(agenda)
            b = after[a]
            if not piece[a] or b >= n or piece[a] + piece[b] != both:
                continue
            if bound and skipped(key, a, least, bound):
                continue
            piece[a], piece[b] = both, ""
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                propose(a, c)
            if before[a] >= 0:
                propose(before[a], a)
        return [p for p in piece if p]

    def segment(self, text: str, key: int, rate: float) -> list[int]:
        """Ids of one segment."""
        merged = self._merged(text, key, int(rate * (1 << 64)))
        return [i for p in merged for i in ([self.ids[p]] if p in self.ids else [self.byte_ids[x] for x in p.encode()])]

    def encode_all(self, texts: list[str], keys: list[int], rate: float) -> list[np.ndarray]:
        """Ids of each text; an empty text has none."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        words: list[str] = []
        own: list[np.ndarray] = []
        spans: list[tuple[int, int, int]] = []

        def flush() -> None:
            if words:
                ids, counts = self._segments(words, np.concatenate(own), rate)
                ends = np.concatenate([[0], np.cumsum(counts)])
                for text, a, z in spans:
                    found[text].append(ids[ends[a] : ends[z]])
                words.clear()
                own.clear()
                spans.clear()

        for k, (text, key) in enumerate(zip(texts, keys)):
            done = 0
            for part, plain in enumerate(text.split(SPACE) if text else []):
                if part:
                    flush()
                    found[k].append(self._bytes_of_space)
                    segments = re.findall("^[^ ]+| +[^ ]*", plain)
                    got = self._odd_part(segments, key, done, rate)
                    done += len(segments)
                    found[k].append(got)
                    continue
                mine = plain.split(" ")
                if "" in mine:
                    mine = [s[1:] for s in _SEGMENT.findall(SPACE + plain.replace(" ", SPACE))]
                key_of = _keys(key, len(mine))
                for at in range(0, len(mine), _ROWS):
                    some = mine[at : at + _ROWS]
                    spans.append((k, len(words), len(words) + len(some)))
                    words += some
                    own.append(key_of[at : at + _ROWS])
                    if len(words) >= _ROWS:
                        flush()
                done = len(mine)
        flush()
        return [np.concatenate(f) if f else np.empty(0, "<u4") for f in found]

    def _odd_part(self, segments: list[str], key: int, done: int, rate: float) -> np.ndarray:
        """Ids of what follows a character U+2581 in a text, whose first segment has no space before it."""
        own = _keys(key, done + len(segments))[done:]
        return np.array([i for s, x in zip(segments, own.tolist()) for i in self.segment(s.replace(" ", SPACE), x, rate)], "<u4")

    def encode(self, text: str, key: int = 0, rate: float = 0.0) -> np.ndarray:
        return self.encode_all([text], [key], rate)[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, n_pieces, ids_crc32, lossless) of every whole text, and with ``ids`` the ids.

    The key of a text is a hash of its id under the seed, so repeated rows are cut alike. A null
    text is empty and has no pieces; a text of any length is encoded whole; a null id has a key like any
    other; lossless says that decoding gave the text back. Merges of equal score are taken from the
    left. Other columns are ignored, whatever their names; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part, out = b.slice(at, 1024), []
                texts = part.column(2).to_pylist()
                for t, got in zip(texts, m.encode_all(texts, part.column(1).to_pylist(), rate)):
                    row = (len(got), zlib.crc32(got.tobytes()), m.decode(got.tolist()) == t)
                    out.append((*row, got) if ids else row)
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*out), types))], names)

    names = ["id", "n_pieces", "ids_crc32", "lossless", *(["ids"] * ids)]
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 63) - 1))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * ids)
