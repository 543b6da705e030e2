"""Quality classifier: a sparse ensemble of rules read off trees.

Statistics of each text come from one pass over its bytes. Shallow trees, grown one
after another on the gradient of the logistic loss over bootstrap samples,
give paths; each path is a conjunction of thresholds. Lasso logistic
regression over rules and standardised statistics keeps a few of them, and the
kept ones are compiled into one Spark column expression, so scoring needs no
model object on the executors.

Fitting uses a bounded sample: at most ``SAMPLE`` labelled rows, those of the
least hash of their id. Scores cover every row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamlode.llm.common import crc_mod, lean, numbered

SAMPLE = 20_000
STATS = [
    "log_words", "log_bytes", "word_len", "symbols", "digits", "upper", "bangs", "punct", "spaces", "high_bytes",
    "distinct_words", "top_word", "distinct_lines", "words_per_line", "symbol_words", "upper_words", "distinct_pairs", "stops", "long_words",
]
_SYMBOLS, _DIGITS, _UPPER, _PUNCT = b"#$%&*{}[]<>\\/|@^~=+_", b"0123456789", bytes(range(65, 91)), b".,;:?'\"()-"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The values of STATS; a null or empty text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n, m = len(raw), len(words)
    if not m:
        return [0.0] * len(STATS)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(m), np.log1p(n), sum(map(len, words)) / m, share(_SYMBOLS), share(_DIGITS), share(_UPPER), share(b"!"), share(_PUNCT), 1 - sum(map(len, words)) / n, share(_HIGH),
        len(counts) / m, max(counts.values()) / m, len(set(lines)) / len(lines), np.log1p(m / len(lines)),
        sum(c for w, c in counts.items() if w[-1] in _SYMBOLS) / m, sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / m,
        pairs / max(1, m - 1), sum(1 for w in words if len(w) <= 3) / m, sum(1 for w in words if len(w) > 12) / m,
    ]


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns but the text and, as column ``stat_<name>``, each statistic of the text."""
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*keep, F.col(text_col).cast("string"))
    schema = rows.drop(text_col).schema
    for s in STATS:
        schema = schema.add(f"stat_{s}", "double")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([statistics(t.as_py()) for t in b.column(b.num_columns - 1)], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c) for c in values.T)], schema.fieldNames())

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, above, t in self.terms:
            out &= (x[:, j] > t) == above
        return out

    def column(self) -> Column:
        out = None
        for j, above, t in self.terms:
            stat = F.col(f"stat_{STATS[j]}")
            term = stat > F.lit(t) if above else stat <= F.lit(t)
            out = term if out is None else out & term
        return out


def _tree(x: np.ndarray, g: np.ndarray, depth: int, terms: tuple, cuts: list[np.ndarray], least: int) -> tuple[list[Rule], list[tuple[tuple, float]]]:
    """Least-squares tree on g; gives the rules of all its nodes and its leaves."""
    best = None
    if depth and len(g) >= 2 * least:
        total, n = g.sum(), len(g)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            bins = np.searchsorted(cut, x[:, j], "left")  # bin k: cut[k-1] < x <= cut[k]
            left_n = np.cumsum(np.bincount(bins, minlength=len(cut) + 1))[:-1]
            left_g = np.cumsum(np.bincount(bins, g, len(cut) + 1))[:-1]
            ok = (left_n >= least) & (n - left_n >= least)
            if ok.any():
                gain = np.where(ok, left_g**2 / np.maximum(left_n, 1) + (total - left_g) ** 2 / np.maximum(n - left_n, 1), -1)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0]:
                    best = (gain[k], j, float(cut[k]))
    if best is None:
        return [], [(terms, float(g.mean()) if len(g) else 0.0)]
    _, j, t = best
    rules, leaves = [], []
    for above in (False, True):
        side, mask = (*terms, (j, above, t)), (x[:, j] > t) == above
        r, lv = _tree(x[mask], g[mask], depth - 1, side, cuts, least)
        rules += [Rule(side), *r]
        leaves += lv
    return rules, leaves


def _lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """FISTA; the intercept is free."""
    n, p = z.shape
    step = 4.0 / (np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2 / n + 1)
    w, b = np.zeros(p), 0.0
    v, c, t = w, b, 1.0
    for _ in range(steps):
        r = weight * (1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y) / n
        w2 = v - step * (z.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass(frozen=True)
class RuleEnsemble:
    """A logistic model over rules and clipped, standardised statistics."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[int, float, float, float], ...]  # statistic, low, high, weight a unit

    def score(self) -> Column:
        """Probability of label 1, over the stat_ columns."""
        total = F.lit(float(self.intercept))
        for rule, w in self.rules:
            total = total + F.when(rule.column(), float(w)).otherwise(0.0)
        for j, low, high, w in self.linear:
            total = total + F.least(F.greatest(F.col(f"stat_{STATS[j]}"), F.lit(low)), F.lit(high)) * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.0008, seed: int = 7) -> RuleEnsemble:
    """x: rows of STATS; y: 0 or 1. One class only, or no rows, gives a constant score."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(0.0 if not len(y) else (6.0 if y[0] else -6.0), (), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    rules: dict[Rule, None] = {}
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-raw))
        pick = rng.integers(0, len(y), len(y))
        found, leaves = _tree(x[pick], g[pick], depth, (), cuts, max(5, len(y) // 200))
        rules.update(dict.fromkeys(found))
        for terms, value in leaves:
            raw += 2.0 * value * Rule(terms).holds(x)
    kept = list(rules)
    low, high = np.quantile(x, 0.01, axis=0), np.quantile(x, 0.99, axis=0)
    clipped = np.clip(x, low, high)
    mean, sd = clipped.mean(0), clipped.std(0)
    live = sd > 1e-12
    z = np.hstack([np.array([r.holds(x) for r in kept], float).T.reshape(len(y), -1), np.where(live, (clipped - mean) / np.where(live, sd, 1), 0) * 0.4])
    w, b = _lasso_logistic(z, y.astype(float), np.ones(len(y)), penalty)
    unit = np.where(live, w[len(kept) :] * 0.4 / np.where(live, sd, 1), 0)
    return RuleEnsemble(
        float(b - (unit * mean).sum()),
        tuple((r, float(v)) for r, v in zip(kept, w) if abs(v) > 1e-9),
        tuple((j, float(low[j]), float(high[j]), float(v)) for j, v in enumerate(unit) if abs(v) > 1e-12),
    )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int | None = None, folds: int = 3, sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on labelled rows whose crc32(id) mod ``folds`` is not ``fold``.

    Rows of null id, text or label are not learned from; an id labelled more than
    once counts once, with its least label, and an id of several texts with the least
    statistics. At most ``sample`` rows are used, those of the least hash of their id, then the least id.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    if fold is not None:
        marked = marked.where(crc_mod(F.col("id"), folds) != fold)
    marked = marked.groupBy("id").agg(F.min("y").alias("y"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = with_statistics(texts.join(F.broadcast(marked), "id").select("id", "y", "text"), "text")
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(*(f"stat_{s}" for s in STATS))).alias("s")).select("id", "y", "s.*")
    got = rows.orderBy("id").toPandas()
    return fit(got[[f"stat_{s}" for s in STATS]].to_numpy(float), got["y"].to_numpy(int))


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row; a null text scores as an empty one, a text of any length as a whole.

    Repeated rows and null ids each get a row; other columns are ignored, whatever their names;
    no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return with_statistics(rows, "text").select("id", model.score().alias("score"))


def kept(docs: DataFrame, model: RuleEnsemble, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score ``least`` or more, all columns kept; nulls, lengths and repeats as in ``score``; columns may have any names."""
    at = docs.columns.index(text_col)
    rows = numbered(docs).withColumn("read", F.col(f"c{at}"))
    good = with_statistics(rows, "read").where(model.score() >= least)
    return good.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)
