"""Repeats of 200 bytes against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from seamlode.llm import suffix


def _brute(texts: list[str], width: int) -> list[tuple[int, int, int, str]]:
    raws = [t.encode() for t in texts]
    seen = Counter(r[k : k + width] for r in raws for k in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        left = bytes(x for x, g in zip(r, gone) if not g)
        runs = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CROWDED", 3)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(90), "Released under the same common line of words, which is long enough to hold a mark. "
    texts = [text(rng.randint(0, 200)) for _ in range(25)]
    texts += [text(rng.randint(5, 60)) + shared[: rng.randint(150, len(shared))] + text(30) for _ in range(12)]
    texts += [text(40) + line + text(40) for _ in range(20)]
    texts += ["a" * 1000, "ab" * 400, "ab" * 90, "é" * 300, "", "x" * 199, "x" * 200, "abc" * 200 + text(80) + "abc" * 70, texts[3], texts[3]]
    near = text(150)
    for _ in range(8):
        k = rng.randrange(len(near))
        texts.append(near[:k] + "Q" + near[k:])
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(900, None, None)], "doc_id long, text string, mark string").repartition(3)
    got = {r["doc_id"]: r for r in suffix.remove_repeats(df, text=True).collect()}
    for k, want in enumerate(_brute(texts, 200)):
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == want, k
    assert got[900]["n_bytes"] == 0 and got[900]["kept_text"] == "" and got[5]["mark"] == "x"
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_suffix_blocks_order():
    rng = random.Random(1)
    raw = b"".join(rng.choice([b"ab", b"abcabc" * 20, b"x"]) for _ in range(60))
    import numpy as np

    at = np.arange(len(raw))
    order, _ = suffix.SuffixBlocks(raw, 400).sort(at, np.zeros(len(raw), np.int64))
    padded = raw + bytes(700)
    keys = [padded[k : k + 400] for k in at[order]]
    assert keys == sorted(keys)


def test_columns_of_any_name(spark):
    text = "word " * 60 + "é" * 30
    df = spark.createDataFrame([(1, text + "a", 7, "p", 1.5, None), (2, text + "b", None, "q", None, 3)], "doc_id long, text string, n_bytes int, `a.b` string, _uid double, _mark int")
    got = suffix.remove_repeats(df, text=True)
    assert got.columns == ["doc_id", "a.b", "_uid", "_mark", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert sorted((r["doc_id"], r["a.b"], r["_uid"]) for r in got.collect()) == [(1, "p", 1.5), (2, "q", None)]
    left = suffix.without_repeats(df.selectExpr("*", "1L AS n_chars", "'k' AS kept_text"))
    assert left.columns == [*df.columns, "n_chars", "kept_text"]
    assert sorted((r["doc_id"], r["text"], r["n_chars"], r["n_bytes"], r["kept_text"]) for r in left.collect()) == [(1, "a", 1, 7, "k"), (2, "b", 1, None, "k")]


def test_past_a_chunk(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(200_000))  # more than a chunk of the marks and a buffer of the sort
    shared = long[1_048_400:1_048_900]
    df = spark.createDataFrame([(1, long), (2, "x" * 50 + shared + "y" * 50)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(df).collect()}
    assert got == {1: (len(long), 500, 1), 2: (600, 500, 1)}
