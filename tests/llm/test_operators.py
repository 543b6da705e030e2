"""The other operators against brute force, and their nulls, empties, repeats and clashing columns."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seamlode.llm import common, hmm, packing, rules, simhash, sst, tokens, topk
from seamlode.llm.components import connected_components

VOCAB = tokens.public_vocabulary()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "the", "of", "naïve", "x1", "l'été"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [texts[5], texts[5] + " end", "", "  two  spaces\n\nand lines ", "日本語 <|endoftext|> text", "a " * 3000]
    rows = [*enumerate(texts), (99, None), (None, "no id"), (5, texts[5]), (-7, "negative id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS uid", "'z' AS component", "3.0 AS score")
    return rows, df


def _library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB).encode(text or "", add_special_tokens=False).ids + [2]


def test_shards(spark, docs):
    rows, df = docs
    folder = sst.shard_folder(spark)
    manifest = sst.write_shards(df, folder, VOCAB)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sst.scan_shards(manifest).collect()))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[1] for g in got] == [r[0] for r in ordered]
    ids = {id(r): _library(r[1]) for r in ordered}
    assert Counter((g[1], g[2], g[3]) for g in got) == Counter((r[0], len(ids[id(r)]), zlib.crc32(np.array(ids[id(r)], "<u4").tobytes())) for r in ordered)
    assert [g[0] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]
    found = 0
    for r in manifest.collect():
        store, place = common.open_store(r["path"])
        with store.open_input_file(place) as source:
            reader = sst.ShardReader(source)
            found += len(reader.get(5))
            assert all(x.tolist() == _library(rows[5][1]) for x in reader.get(5)) and reader.get(12345678) == []
    assert found == 2
    assert sst.scan_shards(sst.write_shards(df.limit(0), sst.shard_folder(spark), VOCAB)).count() == 0


def test_damaged_shards_and_long_runs_of_one_id(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(300)] + [(i, "x") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = sst.write_shards(df, sst.shard_folder(spark), VOCAB)
    assert manifest.where("n_docs > 0").count() > 2  # one id, or none, fills more than one shard
    got = sst.scan_shards(manifest).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    total = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == total
        total += r["n_tokens"]
    path = manifest.where("n_docs > 0").first()["path"]
    store, place = common.open_store(path)
    raw = bytearray(store.open_input_file(place).read())
    reader = sst.ShardReader(store.open_input_file(place))
    raw[len(raw) - sst._FOOTER.size - 1] ^= 1  # the last byte of the filter
    with store.open_output_stream(place) as out:
        out.write(bytes(raw))
    with pytest.raises(ValueError):
        list(sst.ShardReader(store.open_input_file(place)).scan())
    del reader


def test_lookup_takes_few_keys(monkeypatch):
    import io

    import pyarrow as pa

    sink = pa.BufferOutputStream()
    w = sst.ShardWriter(sink)
    for i in range(5000):
        w.add(sst.key_of(2 * i), np.array([i % 7], "<u4"))
    w.close()
    reader, read = sst.ShardReader(pa.BufferReader(sink.getvalue())), []
    plain = sst.ShardReader._key_at
    monkeypatch.setattr(sst.ShardReader, "_key_at", staticmethod(lambda body, at: read.append(at) or plain(body, at)))
    assert [x.tolist() for x in reader.get(1234)] == [[617 % 7]] and len(read) <= 10
    assert reader.get(1235) == [] and io is not None


def _naive_best_fit(lengths, size, space):
    open_bins, closed, out = [], 0, []  # (free, bin), in the order in which they were last left so
    for x in lengths:
        fits = [b for b in open_bins if b[0] >= x]
        if fits:
            free = min(b[0] for b in fits)
            bin_ = [b for b in open_bins if b[0] == free][-1]
            open_bins.remove(bin_)
        else:
            if len(open_bins) == space:
                free = min(b[0] for b in open_bins)
                open_bins.remove([b for b in open_bins if b[0] == free][-1])
            bin_ = (size, closed)
            closed += 1
        out.append((bin_[1], size - bin_[0]))
        if bin_[0] > x:
            open_bins.append((bin_[0] - x, bin_[1]))
    return out


def test_placement_is_best_fit():
    rng = random.Random(2)
    for space in (1, 3, 20):
        lengths = [rng.randint(1, 64) for _ in range(600)]
        packer = packing.BestFit(64, space)
        assert [packer.place(x) for x in lengths] == _naive_best_fit(lengths, 64, space)


def test_packing(spark, docs):
    rows, df = docs
    got = packing.pack(packing.pieces(df, VOCAB, size=64), size=64, space=8).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    total = sum(len(_library(t)) for _, t in rows)
    assert sum(r["length"] for r in got) == total and len(bins) <= math.ceil(total / 64) * 1.1 + 1
    assert all(r["length"] == 64 for r in got if r["piece"] > 0)
    assert packing.pack(packing.pieces(df.limit(0), VOCAB)).count() == 0


def test_packing_of_many_pieces_is_tight(spark):
    rng = random.Random(8)
    lengths = [min(64, int(rng.lognormvariate(3.2, 0.7)) + 1) for _ in range(4000)]
    cut = spark.createDataFrame([(i, 0, 0, x, i) for i, x in enumerate(lengths)], packing._PIECE)
    got = packing.pack(cut, size=64, space=64).select("doc_id", "length", "sequence_id").collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter(enumerate(lengths))
    assert len({r["sequence_id"] for r in got}) <= sum(lengths) / 64 * 1.08


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, docs):
    rows, df = docs
    rng, center = random.Random(9), random.Random(1).getrandbits(64)
    fps = [center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)] + [rng.getrandbits(64) for _ in range(50)]
    distinct = spark.createDataFrame([(f.to_bytes(8, "big"),) for f in sorted(set(fps))], "fp binary")
    edges = simhash.links(distinct)
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in connected_components(edges).collect()}
    root = {f: f for f in set(fps)}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {f: got.get(f, f) for f in root} == {f: find(f) for f in root}
    found = simhash.near_duplicate_classes(df).collect()
    assert Counter((r["id"], r["fp"].hex()) for r in found) == Counter((i, f"{_fingerprint(t):016x}") for i, t in rows)
    empty = {r["component"] for r in found if r["fp"] == bytes(8)}
    assert len(empty) == 1
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and kept.where("text = ''").count() + kept.where("text is null").count() <= 1
    assert simhash.near_duplicate_classes(df.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(3)]) for i in range(300)]
    rows += [(50, rows[50][1]), (301, rows[0][1]), (302, None), (303, [1.0, None] + [0.0] * 6), (304, [float("nan")] * 8), (None, [1.0] * 8), (305, [1.0, 2.0]), (306, [1e30] * 8), (307, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS score")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, every=50).collect())
    valid = [(i, [math.floor(256 * x) for x in v] + [0] * (8 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, q) in enumerate(valid):
        if i % 50 == 0:
            s = sorted((-min(max(sum(x * y for x, y in zip(q, v)), -(2**63)), 2**63 - 1), j) for b, (j, v) in enumerate(valid) if b != a)[:5]
            want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_word_cache_holds_the_words_of_a_large_shard(monkeypatch):
    monkeypatch.setattr(tokens, "_encoders", {})
    path = tokens.public_vocabulary()
    for at in range(0, 460_000, 20_000):
        tokens.encode(["a " + " ".join(f"{i}" for i in range(at, at + 20_000))], path)
    assert len(tokens._encoders[path].words) == 460_000  # a full cache is emptied


def test_packing_leaves_room_to_other_stages(monkeypatch):
    from seamlode.llm import common

    monkeypatch.setattr(tokens, "_encoders", {})
    path = tokens.public_vocabulary()
    text = "a " + " ".join(f"{i}" for i in range(1000))
    whole = tokens.encode([text], path)[0].tolist()
    assert tokens.encode([text], path, room=(100, 100))[0].tolist() == whole and len(tokens._encoders[path].words) <= 100
    assert tokens.SMALL[0] < tokens._CACHE_WORDS and tokens.SMALL[1] < tokens._CACHE_UNITS
    assert list(common.lean(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3]
    assert not tokens._encoders  # a task of another stage drops what was kept


def test_components_end_in_one_chunk(spark, monkeypatch):
    from seamlode.llm import components

    calls = []
    star = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda e: calls.append(1) or star(e))
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (None, 3)], "u long, v long").repartition(4)
    want = {(i, 0) for i in range(301)} | {(1000, 1000), (1001, 1000)}
    assert {tuple(r) for r in components.connected_components(chain).collect()} == want and not calls
    monkeypatch.setattr(components, "FILE_ROWS", 10)
    monkeypatch.setattr(components, "_CHUNK", 50)
    assert {tuple(r) for r in components.connected_components(chain).collect()} == want and calls


def test_one_of_each_deals_out_few_texts(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(400)] + [(1000 + i, " ".join(f"w{i}x{j}" for j in range(29)) + " end") for i in range(10)], "doc_id long, text string")
    assert simhash.one_of_each(df).count() == 400
    texts = df.selectExpr("doc_id AS node", "text")
    ends = spark.range(20).selectExpr("id AS node")
    likely = simhash._likely(ends)
    assert texts.where(likely(F.col("node"))).where("node < 20").count() == 20 and texts.where(likely(F.col("node"))).count() < 150
    got = simhash._without(df.withColumnRenamed("doc_id", "uid"), ends)
    assert sorted(r["uid"] for r in got.collect()) == [*range(20, 400), *range(1000, 1010)]


def test_top_k_copies_no_blocks_to_the_driver(spark):
    df = spark.range(300).selectExpr("id AS vec_id", "array(CAST(id AS DOUBLE), 1.0D) AS embedding")
    plan = topk.top_k(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    for cells in (1, 4, 211, 600):
        high, wide = topk._grid(cells, 50)
        assert high * wide >= cells and high + 50 * wide <= cells + 50  # vectors copied, in queries


def test_blocks_keep_their_components():
    for most in (3, 1 << 15, (1 << 31) - 1, 1 << 31, 2.0**70):
        m = np.array([[0.0, most, -most], [1.0, -2.0, 5.0]])
        assert (topk._unpacked(topk._packed(m), 2, 3) == m).all()
    assert topk._unpacked(topk._packed(np.zeros((2, 0))), 2, 0).shape == (2, 0)


def test_bounds_lose_nothing_and_leave_pairs_out():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(3000, 64)) / 8)
    q, least, tally = x[:40], np.empty(40), []
    exact = q @ x.T
    exact[np.arange(40), np.arange(40)] = -np.inf
    least = np.partition(exact, 2995, axis=1)[:, 2995]
    got = list(topk.best_in_block(q, np.arange(40), least, x, np.arange(3000), np.arange(3000), 5, tally))
    assert all(s.tolist() == sorted(e.tolist(), reverse=True)[:5] for (_, _, s), e in zip(got, exact))
    assert tally[0] == 40 * 2999 and tally[-1] < 0.4 * tally[0]


def test_hmm(spark, docs, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(hmm, "HOT", 3)
    monkeypatch.setattr(hmm, "OWN", 2)
    held = F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False))
    got = hmm.score(df, held, states=3, rounds=2).collect()
    is_held = lambda i: i is not None and math.fmod(i, 5) == 2
    words = lambda t: hmm.words_of(t)
    c = Counter(w for i, t in rows if not is_held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, is_held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert hmm.score(df.limit(0), held).count() == 0


def test_hmm_score_is_the_model_s(spark, docs, monkeypatch):
    rows, df = docs
    held = F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False))
    models, train = [], hmm._train
    monkeypatch.setattr(hmm, "_train", lambda *a: models.append(train(*a)) or models[-1])
    got = hmm.score(df, held, states=3, rounds=2).collect()
    again = hmm.score(df.repartition(7, "text"), held, states=3, rounds=2).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 7))
    assert sorted(map(key, got)) == sorted(map(key, again))  # whatever the layout
    m = models[0]
    c = Counter(w for i, t in rows if not (i is not None and math.fmod(i, 5) == 2) for w in hmm.words_of(t))
    own = {w: 1 + k for k, w in enumerate(sorted((w for w in c if w), key=lambda w: (-c[w], w))[: hmm.OWN])}
    own[b""] = 0
    mass, size = Counter(), Counter()
    for w, n in c.items():
        mass[hmm.class_of(w, own)] += n
        size[hmm.class_of(w, own)] += 1
    want = []
    for i, t in rows:
        forward, total = None, 0.0
        for w in hmm.words_of(t):
            k = hmm.class_of(w, own)
            forward = (m.start if forward is None else forward @ m.move) * m.emit[k]
            total += math.log10(forward.sum()) + math.log10((c[w] + 1) / (mass[k] + size[k] + 1))
            forward = forward / forward.sum()
        want.append((str(i), len(hmm.words_of(t)), round(total, 7)))
    assert sorted(map(key, got)) == sorted(want)


def test_long_sequences_are_learned_from_whole(monkeypatch):
    rng = np.random.default_rng(3)
    m = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3).T)
    seqs = [rng.integers(0, 6, n).astype("<u2") for n in (50, 7, 23, 1)]
    whole = m.expected(seqs)
    monkeypatch.setattr(hmm, "_BATCH_TOKENS", 5)
    for a, b in zip(whole, m.expected(seqs)):
        assert np.allclose(a, b, rtol=1e-10)


def test_forward_is_exact():
    rng = np.random.default_rng(4)
    k = 3
    m = hmm.Hmm(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(5), k).T)
    seq = np.array([0, 3, 1, 4], "<u2")
    total = 0.0
    for path in np.ndindex(*[k] * len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[o, b]
        total += p
    assert abs(m.log10([seq, seq[:2]])[0] - math.log10(total)) < 1e-12
    starts, moves, emits = m.expected([seq, seq[:2]])
    assert abs(starts.sum() - 2) < 1e-9 and abs(moves.sum() - 4) < 1e-9 and abs(emits.sum() - 6) < 1e-9


def test_quality_rules(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(["the", "stone", "river", "of", "walks", "green", f"w{rng.randrange(400)}"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["###", "buy$$$", "%%%"]) for _ in range(60)) for _ in range(60)]
    rows = [*enumerate(good + bad), (900, None), (901, ""), (None, "x"), (3, good[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS score")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(210)] + [(3, 1), (None, 0), (5, None)], "doc_id long, quality int")
    model = rules.train(df, labels, fold=1, folds=3)
    got = rules.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    right = sum((r["score"] >= 0.5) == (r["id"] < 150) for r in got if r["id"] is not None and r["id"] < 210)
    assert right >= 209
    assert rules.score(df.limit(0), rules.train(df.limit(0), labels.limit(0))).count() == 0
    several = df.unionByName(df.where("doc_id < 150").withColumn("text", F.concat(F.lit("### "), "text")))
    assert rules.train(several.repartition(3), labels) == rules.train(several.repartition(5, "text"), labels)
    left = rules.kept(df, model)
    assert left.columns == df.columns and left.count() == sum(r["score"] >= 0.5 for r in got)


def test_quality_on_held_out_labels(spark):
    from seamlode.llm import queries

    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = queries.op10_quality_rules(spark, data).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got) > 50


def test_very_long_texts(spark, monkeypatch):
    """Past every block, buffer and batch of the operators."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma,", "Delta"]) for _ in range(150_000))
    df = spark.createDataFrame([(1, long), (2, "short text"), (3, long)], "doc_id long, text string")
    h = {r["id"]: (r["fp"].hex(), r["component"]) for r in simhash.near_duplicate_classes(df).collect()}
    assert h[1] == (f"{_fingerprint(long):016x}", 1) and h[3] == h[1]
    monkeypatch.setattr(hmm, "_BATCH_TOKENS", 40_000)
    s = {r["doc_id"]: r for r in hmm.score(df, F.lit(False), states=2, rounds=1).collect()}
    assert s[1]["n_tokens"] == 150_001 and abs(s[1]["score"] - s[3]["score"]) < 1e-6
    got = {r["doc_id"]: r for r in sst.scan_shards(sst.write_shards(df, sst.shard_folder(spark), VOCAB)).collect()}
    ids = _library(long)
    assert got[1]["n_tokens"] == len(ids) and got[1]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    cut = packing.pieces(df, VOCAB).where("doc_id = 1").collect()
    assert sum(r["length"] for r in cut) == len(ids) and len(cut) == math.ceil(len(ids) / 1024)
