"""Hidden Markov language model over word tokens.

Emission factors through a class of each word: b_s(w) = phi_s(class(w)) * p(w | class(w)).
The ``OWN`` most frequent training words have a class each; all other words share
``SHARED`` classes by their first and last two bytes; the end of a text is class 0.
p(w | class) is (c + 1) / (N_class + V_class + 1), so any unseen word has a share.
The model thus stays proper and its trained part bounded, while word counts cover the
whole training corpus.

Steps: words are counted in the tasks and summed by word; each text becomes its
sequence of classes; Baum-Welch runs over all training sequences, each task giving
expected counts that are summed by class; the scaled forward recursion gives
the exact likelihood of every text. Counts of at most ``HOT`` words, the most frequent, go
to the tasks; rarer words get theirs by a join.

The start values come from all training texts as well: texts are dealt to the states by the signs
of random projections of their class shares, and then, ``DEALS`` times, to the state whose
shares make them likeliest. All sums run over the whole corpus, so results do not depend on how
the table is cut into files.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamlode.llm.common import staged

END = b""
OWN, SHARED = 3071, 1024
CLASSES = 1 + OWN + SHARED
HOT = 200_000
DEALS = 3
_HELD = 400_000
_WORD_BYTES = 256
_BATCH_TOKENS = 400_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, then the end."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def class_of(word: bytes, own: dict[bytes, int]) -> int:
    found = own.get(word)
    return found if found is not None else 1 + OWN + zlib.crc32(word[:2] + b" " + word[-2:]) % SHARED


def word_counts(rows: DataFrame) -> DataFrame:
    """rows(text) -> (word, c): how often each token occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column(0):
                counts.update(words_of(t.as_py()))
                if len(counts) > _HELD:
                    yield flush()
        yield flush()

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _frequent(counts: DataFrame) -> dict[bytes, int]:
    """Words of the highest counts, at most HOT and none of over _WORD_BYTES: all from a bound on that is read off a histogram."""
    counts = counts.where(F.length("word") <= _WORD_BYTES)
    level = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(counts.groupBy(level.alias("b")).count().collect(), reverse=True)  # under 1,100 levels
    total, least = 0, None
    for b, n in histogram:
        total += n
        if total > HOT:
            break
        least = b
    if least is None:
        return {}
    return {bytes(r[0]): r[1] for r in counts.where(level >= least).select("word", "c").collect()}


@dataclass
class Hmm:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (C, K): phi_s(class), one column a state

    def batches(self, seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Groups of sequences of like length, longest first: rows, steps' live counts, classes by step."""
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        at = 0
        while at < len(order):
            size, end = 0, at
            while end < len(order) and (end == at or size + len(seqs[order[end]]) <= _BATCH_TOKENS):
                size += len(seqs[order[end]])
                end += 1
            group = order[at:end]
            lens = np.array([len(seqs[i]) for i in group])
            flat = np.concatenate([seqs[i] for i in group]).astype(np.int64)
            step = np.concatenate([np.arange(n) for n in lens])
            by_step = flat[np.argsort(step, kind="stable")]
            live = np.bincount(step)
            yield group, live, by_step
            at = end

    def forward(self, live: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward values and scales of all steps."""
        e = self.emit[classes]
        alpha, scale = np.empty_like(e), np.empty(len(e))
        at, last = 0, None
        for t, n in enumerate(live.tolist()):
            a = (self.start if t == 0 else last[:n] @ self.move) * e[at : at + n]
            s = a.sum(1)
            a /= s[:, None]
            alpha[at : at + n], scale[at : at + n] = a, s
            last, at = a, at + n
        return alpha, scale

    def expected(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions (Baum-Welch)."""
        k = len(self.start)
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(self.emit)
        for _, live, classes in self.batches([s for s in seqs if len(s) <= _BATCH_TOKENS]):
            alpha, scale = self.forward(live, classes)
            e = self.emit[classes] / scale[:, None]
            beta = np.ones((live[0], k))
            ends = np.cumsum(live)
            for t in range(len(live) - 1, -1, -1):
                n, z = live[t], ends[t]
                a = z - n
                if t + 1 < len(live):
                    m = live[t + 1]
                    w = e[z : z + m] * beta[:m]
                    moves += alpha[a : a + m].T @ w
                    beta[:m] = w @ self.move.T
                gamma_t = alpha[a:z] * beta[:n]
                if t == 0:
                    starts += gamma_t.sum(0)
                alpha[a:z] = gamma_t  # the moves out of this step are done, and the step before reads its own rows
            for s in range(k):
                emits[:, s] += np.bincount(classes, alpha[:, s], len(emits))
        for s in seqs:
            if len(s) > _BATCH_TOKENS:
                for total, part in zip((starts, moves, emits), self._expected_long(s.astype(np.int64))):
                    total += part
        return starts, moves * self.move, emits

    def _block(self, classes: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward values and scales of a part of a sequence that follows the values ``before``."""
        alpha, scale = self.emit[classes], np.empty(len(classes))
        for t in range(len(classes)):
            alpha[t] *= self.start if before is None else before @ self.move
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
            before = alpha[t]
        return alpha, scale

    def _expected_long(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one sequence of any length, in blocks: forward values are kept at block
        ends only and computed again, block by block, as the backward values come down."""
        k, held = len(self.start), [None]
        for at in range(0, len(seq), _BATCH_TOKENS):
            held.append(self._block(seq[at : at + _BATCH_TOKENS], held[-1])[0][-1].copy())
        moves, emits, after = np.zeros((k, k)), np.zeros_like(self.emit), None
        for block in range(len(held) - 2, -1, -1):
            classes = seq[block * _BATCH_TOKENS : (block + 1) * _BATCH_TOKENS]
            alpha, scale = self._block(classes, held[block])
            e = self.emit[classes] / scale[:, None]
            for t in range(len(classes) - 1, -1, -1):
                if after is None:
                    beta = np.ones(k)
                else:
                    moves += np.outer(alpha[t], after)
                    beta = self.move @ after
                after = e[t] * beta
                alpha[t] *= beta
            for s in range(k):
                emits[:, s] += np.bincount(classes, alpha[:, s], len(emits))
        return alpha[0], moves, emits

    def updated(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: np.ndarray) -> Hmm:
        """Maximisation, smoothed by the classes' overall shares."""
        emits = emits + 2.0 * prior[:, None]
        return Hmm((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emits / emits.sum(0))

    def log10(self, seqs: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence; one step's forward values are held at a time."""
        out = np.zeros(len(seqs))
        for group, live, classes in self.batches(seqs):
            total, at, last = np.zeros(len(group)), 0, None
            for t, n in enumerate(live.tolist()):
                a = (self.start if t == 0 else last[:n] @ self.move) * self.emit[classes[at : at + n]]
                s = a.sum(1)
                last = a / s[:, None]
                total[:n] += np.log(s)
                at += n
            out[group] = total / math.log(10)
        return out


def _summed(seqs: DataFrame, k: int, rows: int, counted) -> np.ndarray:
    """Sum over all sequences of ``counted(sequences)``, a table of rows by k columns; at most so many rows reach the driver."""
    names = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros((rows, k))
        for b in batches:
            full += counted([np.frombuffer(x, "<u2") for x in b.column(0).to_pylist()])
        key = np.flatnonzero(full.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(c) for c in full[key].T)], ["key", *names])

    summed = seqs.mapInArrow(run, "key long, " + ", ".join(f"{n} double" for n in names)).groupBy("key").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((rows, k))
    for row in summed.orderBy("key").collect():
        out[row[0]] = row[1:]
    return out


def initial(seqs: DataFrame, prior: np.ndarray, states: int, seed: int = 3) -> Hmm:
    """Start values: sticky states, each with the class shares of the texts dealt to it."""
    spark, rng = seqs.sparkSession, np.random.default_rng(seed)
    bits = max(1, (states - 1).bit_length())
    project = rng.choice([-1.0, 1.0], (len(prior), bits)) / np.sqrt(prior)[:, None] * (prior > 1e-4)[:, None]
    fixed = spark.sparkContext.broadcast((project, prior @ project))

    def by_sign(found: list[np.ndarray]) -> np.ndarray:
        out, (project, middle) = np.zeros((CLASSES, states)), fixed.value
        for s in found:
            side = (project[s].sum(0) / len(s) > middle) @ (1 << np.arange(bits)) % states
            out[:, side] += np.bincount(s, minlength=CLASSES)
        return out

    counts = _summed(seqs, states, CLASSES, by_sign)
    for _ in range(DEALS):
        shares = counts + prior[:, None] * (0.1 * counts.sum(0) + 1)
        logs = spark.sparkContext.broadcast(np.log(shares / shares.sum(0)))

        def by_likelihood(found: list[np.ndarray], logs=logs) -> np.ndarray:
            out = np.zeros((CLASSES, states))
            for s in found:
                out[:, logs.value[s].sum(0).argmax()] += np.bincount(s, minlength=CLASSES)
            return out

        counts = _summed(seqs, states, CLASSES, by_likelihood)
        logs.unpersist()
    fixed.unpersist()
    emit = counts + prior[:, None] * (0.2 * counts.sum(0) + 1)
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)), emit / emit.sum(0))
    np.fill_diagonal(model.move, 0.9 if states > 1 else 1.0)
    return model


def _train(seqs: DataFrame, model: Hmm, prior: np.ndarray, rounds: int) -> Hmm:
    """Baum-Welch over all sequences: expected counts summed by class across tasks."""
    spark, k = seqs.sparkSession, len(model.start)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expected(found: list[np.ndarray], shared=shared) -> np.ndarray:
            starts, moves, emits = shared.value.expected(found)
            return np.vstack([emits, moves, starts])

        full = _summed(seqs, k, CLASSES + k + 1, expected)
        shared.unpersist()
        if not full.any():
            break
        model = model.updated(full[-1], full[CLASSES:-1], full[:CLASSES], prior)
    return model


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", states: int = 8, rounds: int = 4) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from rows that are not held out; texts of any length are learned from and scored
    whole. A null text is empty, that is its end alone; with nothing to learn from all tokens are unknown.
    Repeated rows are learned from and scored each; words of equal count are ordered by their bytes;
    other columns are ignored, whatever their names; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = staged(word_counts(rows.where(~F.col("held_out")).select("text")), "word-counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = _frequent(counts.where(F.col("word") != F.lit(bytearray(END))))
    own = {w: 1 + i for i, w in enumerate(sorted(hot, key=lambda w: (-hot[w], w))[:OWN])}
    own[END] = 0
    if n_all:
        hot[END] = counts.where(F.col("word") == F.lit(bytearray(END))).first()[1]
    known = spark.sparkContext.broadcast((hot, own))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value[1]
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([class_of(w, own) for w in b.column(0).to_pylist()], pa.int64()), b.column(1)], ["cls", "c"])

    size = np.zeros(CLASSES)
    mass = np.zeros(CLASSES)
    for cls, c, v in counts.mapInArrow(classes, "cls long, c long").groupBy("cls").agg(F.sum("c"), F.count("*")).collect():
        mass[cls], size[cls] = c, v
    prior = (mass + 1) / (mass + 1).sum()
    below = np.log10(mass + size + 1)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hot, own = known.value
        parts = {w: (math.log10(c + 1), class_of(w, own)) for w, c in hot.items()}
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, held, texts = b.columns
            for at in range(0, len(ids), 512):
                out = []
                for t in texts.slice(at, 512):
                    ws = words_of(t.as_py())
                    got = [parts.get(w) for w in ws]
                    rare = [w for w, g in zip(ws, got) if g is None]
                    seq = np.array([class_of(w, own) if g is None else g[1] for w, g in zip(ws, got)], "<u2")
                    out.append((uid, len(ws), len(ws) - len(rare), math.fsum(g[0] for g in got if g is not None), seq.tobytes(), rare))
                    uid += 1
                cols = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), held.slice(at, 512), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "held_out", "uid", "n_tokens", "n_hot", "hot_log", "seq", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = staged(rows.mapInArrow(coded, f"doc_id {kind}, held_out boolean, uid long, n_tokens long, n_hot long, hot_log double, seq binary, rare array<binary>"), "coded")

    learn = texts.where(~F.col("held_out")).select("seq")
    model = _train(learn, initial(learn, prior, states), prior, rounds)
    shared = spark.sparkContext.broadcast((model, below))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, below = shared.value
        for b in batches:
            seqs = [np.frombuffer(x, "<u2") for x in b.column(5).to_pylist()]
            value = model.log10(seqs) - np.array([below[s].sum() for s in seqs])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column(6), pa.array(value)], ["doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "uid", "hmm"])

    values = texts.select("doc_id", "held_out", "n_tokens", "n_hot", "hot_log", "seq", "uid").mapInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_hot long, hot_log double, uid long, hmm double")
    rare = texts.select("uid", F.explode("rare").alias("word"))
    found = rare.join(counts, "word").groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_log"), F.count("*").alias("n_rare"))
    logs = F.col("hot_log") + F.coalesce("rare_log", F.lit(0.0))
    return values.join(found, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(n_all + v_all + 1))).alias("base_score"), (logs + F.col("hmm")).alias("score"),
    )
