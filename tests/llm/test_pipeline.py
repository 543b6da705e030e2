"""The pipeline and its near-duplicate stage against exact shingle similarity."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
from seamlode.llm.common import table

DATA = "/root/testdata/sf0.001"


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _classes(texts):
    """Index -> least index of its class, all pairs compared."""
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if top(i) != top(j) and _jaccard(sets[i], sets[j]) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def _edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in text.split())


def test_near_dedup_is_exact(spark):
    rng, texts, pairs = random.Random(4), [], defaultdict(int)
    for k in range(160):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(12, 400)))
        other = _edited(rng, base, rng.choice([0.01, 0.015, 0.02, 0.025, 0.03, 0.04]))
        texts += [base, other]
        pairs[int(_jaccard(_shingles(base), _shingles(other)) * 20) / 20] += 1
    assert min(pairs[x] for x in (0.75, 0.8, 0.85, 0.9)) >= 10
    base = " ".join(f"v{i}" for i in range(300))
    texts += [_edited(rng, base, 0.012) for _ in range(70)]  # more than a small bucket, partly alike
    texts += ["", None, "  ", "two words", "Two  words", texts[0], texts[0] + " end"]
    want = _classes(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = corpus_pipeline.near_dedup(spark, df, DATA)
    assert got.columns == df.columns
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == [i for i, c in enumerate(want) if c == i]
    assert corpus_pipeline.near_dedup(spark, df.limit(0), DATA).count() == 0


def test_run(spark):
    docs = corpus_pipeline.quality(spark, table(spark, DATA, "documents"), DATA).coalesce(1).cache()
    rows = docs.collect()
    want = _classes([r["text"] for r in rows])
    kept = corpus_pipeline.near_dedup(spark, docs, DATA).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for i, r in enumerate(rows) if want[i] == i)
    bins = defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    for placed in bins.values():
        at = 0
        for offset, length, _ in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert {d for b in bins.values() for _, _, d in b} == {r["doc_id"] for r in kept}


def test_stages_keep_columns_of_any_name(spark):
    docs = table(spark, DATA, "documents").limit(40)
    extra = "score", "_uid", "uid", "kept_text", "n_bytes", "_z", "_mark", "stat_punct", "c0", "node", "text2"
    docs = docs.selectExpr("*", *(f"'{c}' AS {c}" for c in extra), "'dot' AS `a.b`", "CAST(NULL AS INT) AS nothing")
    docs = docs.unionByName(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars", *extra, "`a.b`", "nothing"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert all(r[c] == c for c in extra) and r["a.b"] == "dot" and r["nothing"] is None, name
    packed = corpus_pipeline.packing_stage(spark, docs, DATA)
    assert packed.where("doc_id IS NULL").count() == 1


def test_stages_of_no_documents(spark):
    none = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0


def test_quality_stage_is_its_rules(spark):
    from seamlode.llm import rules

    docs = table(spark, DATA, "documents")
    model = rules.train(docs, table(spark, DATA, "labels"), fold=1, folds=3)
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, DATA).collect()}
    for r in docs.collect():
        x = rules.statistics(r["text"])
        at = {k: v for k, v in enumerate(x)}
        total = model.intercept + sum(w for rule, w in model.rules if all((at[j] > t) == above for j, above, t in rule.terms))
        total += sum(min(max(at[j], low), high) * w for j, low, high, w in model.linear)
        assert (r["doc_id"] in kept) == (total >= 0)
