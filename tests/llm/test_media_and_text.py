"""Image copies, licences, piece dropout."""

from __future__ import annotations

import numpy as np

from seamlode.llm import descriptors, licenses, piece_dropout, tokens


def _image(seed: int, side: int = 96) -> np.ndarray:
    grid = np.random.default_rng(seed).uniform(0, 255, (12, 12))
    return np.round(descriptors._resized(grid, side / 12)).astype(np.uint8)


def test_cropped_and_edited_copies(spark):
    rows = []

    def add(i, a):
        rows.append((i, a.shape[1], a.shape[0], bytearray(a.tobytes())))

    for k in range(6):
        add(k, _image(k))
    add(10, np.ascontiguousarray(_image(0)[8:90, 10:96]))  # cropped
    add(11, np.clip(_image(1) * 0.8 + 20, 0, 255).astype(np.uint8))  # brightness
    edited = _image(2).copy()
    edited[60:90, 60:90] = 0
    add(12, edited)
    add(13, _image(3))  # equal
    rows += [(20, 4, 4, bytearray(b"x")), (21, None, None, None), (22, 0, 0, bytearray())]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")
    got = {r["id"]: r["copy_class"] for r in descriptors.copies(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 10: 0, 11: 1, 12: 2, 13: 3, 20: 20, 21: 21, 22: 22}
    assert descriptors.copies(df.limit(0)).count() == 0


def _row(i, a):
    return i, a.shape[1], a.shape[0], bytearray(np.ascontiguousarray(a).tobytes())


def _brute_classes(images: dict[int, np.ndarray]) -> dict[int, int]:
    """All corners of every pair of images against each other, without tables."""
    found = {i: descriptors.describe(a[None])[0] for i, a in images.items()}
    root = {i: i for i in images}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in images:
        for j in images:
            if i < j and top(i) != top(j) and (images[i].tobytes() == images[j].tobytes() or descriptors.agree(found[i], found[j])):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in images}


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    rng, images = np.random.default_rng(5), {}
    for k in range(45):
        base = _image(k % 3, 64).astype(float)
        images[k] = np.clip(base + rng.normal(0, rng.uniform(0, 9), base.shape), 0, 255).astype(np.uint8)
    for k in range(45, 60):
        images[k] = _image(k, 64)
    df = spark.createDataFrame([_row(i, a) for i, a in images.items()], "image_id long, width int, height int, pixels binary")
    want = _brute_classes(images)
    assert 15 < len(set(want.values())) < 25
    for following, crowd in ((1, 4),):
        monkeypatch.setattr(descriptors, "NEXT", following)
        monkeypatch.setattr(descriptors, "CROWD", crowd)
        got = descriptors.copies(df).collect()
        assert {r["id"]: r["copy_class"] for r in got} == want
        assert {r["id"]: r["n_copies"] for r in got} == {i: list(want.values()).count(c) for i, c in want.items()}


def _turned(a, degrees):
    """About the middle, black outside."""
    h, w = a.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    u, v = np.cos(t) * x + np.sin(t) * y + (w - 1) / 2, np.cos(t) * y - np.sin(t) * x + (h - 1) / 2
    inside = (u >= 0) & (v >= 0) & (u <= w - 1) & (v <= h - 1)
    u0, v0 = np.clip(u.astype(int), 0, w - 2), np.clip(v.astype(int), 0, h - 2)
    fu, fv, b = u - u0, v - v0, a.astype(float)
    out = b[v0, u0] * (1 - fu) * (1 - fv) + b[v0, u0 + 1] * fu * (1 - fv) + b[v0 + 1, u0] * (1 - fu) * fv + b[v0 + 1, u0 + 1] * fu * fv
    return np.where(inside, np.round(out), 0).astype(np.uint8)


def test_recall_of_edited_copies(spark):
    rng, n = np.random.default_rng(7), 8
    size = lambda k: lambda a: np.round(descriptors._resized(a.astype(float), k)).astype(np.uint8)
    edits = [
        size(0.8), size(0.85), size(0.9), size(1.1), size(1.5), lambda a: _turned(a, 10), lambda a: _turned(a, 30), lambda a: np.rot90(a), lambda a: a[10:80, 12:90],
        lambda a: size(0.9)(a[6:90, 6:84]), lambda a: np.clip(a + rng.normal(0, 8, a.shape), 0, 255).astype(np.uint8), lambda a: np.clip(a * 0.7 + 30, 0, 255).astype(np.uint8),
    ]
    rows = [_row(i, _image(i)) for i in range(n)]
    rows += [_row(1000 * (e + 1) + i, f(_image(i))) for e, f in enumerate(edits) for i in range(n)]
    df = spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")
    got = {r["id"]: r["copy_class"] for r in descriptors.copies(df).collect()}
    assert [got[i] for i in range(n)] == list(range(n))
    for e in range(len(edits)):
        assert sum(got[1000 * (e + 1) + i] == i for i in range(n)) >= 0.9 * n, e


def test_corners_are_local():
    """An image of any size has the corners of its parts; a stack gives what its images give alone."""
    big = _image(3, 240)
    whole = descriptors.describe(big[None])[0]
    part = descriptors.describe(big[None, 60:180, 60:180])[0]
    assert len(whole) > 3 * len(part) > 60
    places = {(round(float(c["x"])), round(float(c["y"])), int(c["scale"])) for c in whole if c["scale"] == 0}
    own = [c for c in part if c["scale"] == 0 and 16 < c["x"] < 104 and 16 < c["y"] < 104]
    assert sum((round(float(c["x"])) + 60, round(float(c["y"])) + 60, 0) in places for c in own) >= 0.95 * len(own) > 5
    stack = np.stack([_image(k, 64) for k in range(5)])
    for got, a in zip(descriptors.describe(stack), stack):
        assert got.tobytes() == descriptors.describe(a[None])[0].tobytes()


_APACHE = """# Licensed under the Apache License, Version 2.0 (the "License"); you
# may not use this file except in compliance with the License. You may
# obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0
"""
_GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() {}
"""
_BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
_NEITHER = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
_MIT = """MIT License

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


def test_licenses(spark):
    prose = "The river runs in the valley and the people of the town walk by the water. " * 40
    rows = [
        (1, "a/LICENSE", _MIT), (2, "a/b/x.py", "some code"), (3, "a/b/y.py", _APACHE + "code " * 90), (4, "c/z.py", None), (5, None, "Released under the MIT License."),
        (6, "a/LICENSEE.md", ""), (6, "a/LICENSEE.md", ""), (7, "d/COPYING", _GPL), (8, "d/e/f/g.c", "int x;"), (9, "h/LICENSE.txt", _BSD), (10, "i/LICENSE", _BSD + _NEITHER),
        (11, "j/k.c", "// SPDX-License-Identifier: LGPL-3.0\nint y;"), (12, "k/l.txt", prose + "\nLicensed under CC BY-NC 4.0. More of the river.\n" + prose), (13, "k/m.txt", prose),
        (14, "l/LICENSE", prose), (15, "l/n.txt", "x"), (16, "m/short.txt", "Released under the MIT License."), (17, "m/o.txt", "y"), (18, "p/GPL2", _GPL.replace("version 3", "version 2")),
        (19, "q/w.txt", "Licensed under CC BY 4.0."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 AS license", "2 AS dir", "3 AS uid", "4 AS unit")
    got = sorted(((r["id"], r["license"], r["origin"], r["from_dir"]) for r in licenses.detect(df).collect()), key=str)
    want = [
        (1, "MIT", "header", None), (2, "MIT", "inherited", "a"), (3, "Apache-2.0", "header", None), (4, None, "none", None), (5, "MIT", "header", None), (6, "MIT", "inherited", "a"),
        (6, "MIT", "inherited", "a"), (7, "GPL-3.0", "header", None), (8, "GPL-3.0", "inherited", "d"), (9, "BSD-2-Clause", "header", None), (10, "BSD-3-Clause", "header", None),
        (11, "LGPL-3.0", "header", None), (12, "CC-BY-NC-4.0", "header", None), (13, None, "none", None), (14, None, "none", None), (15, None, "none", None), (16, "MIT", "header", None),
        (17, None, "none", None), (18, "GPL-2.0", "header", None), (19, "CC-BY-4.0", "header", None),
    ]
    assert got == sorted(want, key=str)
    assert licenses.detect(df.limit(0)).count() == 0


def _naive_cosines(texts, least):
    """Best cosine of each text with any paragraph of a template, all units in plain Python."""
    import math
    from collections import Counter

    import regex as re

    listed = licenses._with_spdx(licenses.TEMPLATES)
    vocabulary = {t for _, ts in listed for t in ts}
    strip = lambda t: re.sub(licenses._MARKS, "", t.replace("\r", ""))
    units = [list(dict.fromkeys(re.split(r"\n{2,}", strip(t)) + re.split(r"\n+|(?<=[.!?])[ \t]+(?=\p{Lu})", strip(t)))) for t in texts]
    units = [[licenses._terms(u) for u in us if licenses._terms(u)] for us in units]
    total, df = sum(map(len, units)), Counter(t for us in units for u in us for t in set(u) & vocabulary)
    idf = lambda t: math.log((1 + total) / (1 + df[t])) + 1 if t in vocabulary else math.log(1 + total) + 1
    out = []
    for us in units:
        best = 0.0
        for u in us:
            a = Counter(u)
            size = math.sqrt(sum((n * idf(t)) ** 2 if t in vocabulary else n * idf(t) ** 2 for t, n in a.items()))
            for _, ts in listed:
                b = Counter(ts)
                dot = sum(a[t] * idf(t) * b[t] * idf(t) for t in b if t in a)
                best = max(best, dot / size / math.sqrt(sum((n * idf(t)) ** 2 for t, n in b.items())))
        out.append(round(best, 6) if best >= least else None)
    return out


def test_cosines_are_those_of_all_units(spark):
    data = "/root/testdata/sf0.001"
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()][:150] + [_MIT, _GPL, _BSD, _APACHE, "of the the the of and of and the " * 9]
    df = spark.createDataFrame([(i, f"{i}.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r["id"]: None if r["cosine"] is None else round(r["cosine"], 6) for r in licenses.detect(df, least=0.5).collect()}
    want = _naive_cosines(texts, 0.5)
    assert sum(x is not None for x in want) > 6
    for i, x in enumerate(want):
        assert (got[i] is None) == (x is None), (i, got[i], x)
        assert x is None or got[i] <= x + 1e-6  # the licence chosen need not have the best paragraph


def test_piece_dropout(spark):
    path = tokens.public_vocabulary("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    m = piece_dropout.model(path)
    texts = ["the thing that", "a  b\n\tc", "▁ literal ▁▁", "日本🙂 mixed", " ", "", "x" * 500 + " y", "the thing " * 50, " lead", "a▁b c  d▁", "\U0010ffff q"]
    for t in texts:
        if piece_dropout.SPACE not in t and t:
            assert m.encode(t).tolist() == sp.encode(t)
        for key in (1, 2):
            assert m.decode(m.encode(t, key, 0.3).tolist()) == t
    assert len({tuple(m.encode("unbelievable tokenization", k, 0.5).tolist()) for k in range(8)}) > 3
    df = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (2, None), (None, "x"), (3, "word " * 200_000)], "doc_id long, text string").selectExpr("*", "'v' AS variant", "1 AS key")
    found = piece_dropout.encode_documents(df, path).collect()
    assert sorted([(r["id"], r["n_pieces"] > 0, r["lossless"]) for r in found], key=str) == sorted([(1, True, True), (1, True, True), (2, False, True), (3, True, True), (None, True, True)], key=str)
    assert piece_dropout.encode_documents(df.limit(0), path).count() == 0


def _naive_segment(m, text, key, bound):
    """The agenda as a plain list, rebuilt at every step."""
    piece, place, out = list(text), list(range(len(text))), set()
    while True:
        open_ = [(m.cost[a + b], place[k]) for k, (a, b) in enumerate(zip(piece, piece[1:])) if a + b in m.cost and (place[k], a, b) not in out]
        if not open_:
            return m_ids(m, piece)
        least, at = min(open_)
        k = place.index(at)
        if piece_dropout.skipped(key, at, least, bound):
            out.add((at, piece[k], piece[k + 1]))
            continue
        piece[k] += piece[k + 1]
        del piece[k + 1], place[k + 1]


def m_ids(m, pieces):
    return [i for p in pieces for i in ([m.ids[p]] if p in m.ids else [m.byte_ids[x] for x in p.encode()])]


def test_dropout_is_that_of_the_plain_agenda():
    m = piece_dropout.model(tokens.public_vocabulary("piece_bpe_32k.model"))
    text = "Unbelievably, the tokenization of naïve words; aaaaaaaa banana 1234567 don't übermäßig\nnew lines é " * 3
    text = text.strip()
    for rate in (0.1, 0.5, 1.0):
        bound = int(rate * (1 << 64))
        keys = piece_dropout._keys(99, text.count(" ") + 1).tolist()
        want = [x for w, k in zip(text.split(" "), keys) for x in _naive_segment(m, piece_dropout.SPACE + w, k, bound)]
        assert m.encode(text, 99, rate).tolist() == want


def test_every_candidate_is_drawn_apart(spark):
    path = tokens.public_vocabulary("piece_bpe_32k.model")
    m = piece_dropout.model(path)
    word, n = "unbelievable", 400
    plain = m.segment("▁" + word, 0, 0.0)
    df = spark.createDataFrame([(i, " ".join([word] * n)) for i in range(5)], "doc_id long, text string")
    cuts, several = set(), set()
    for r in piece_dropout.encode_documents(df, path, ids=True).collect():
        assert r["lossless"]
        held, uses = [], []
        for i in r["ids"]:
            if held and m.bytes_of[i].startswith(b" "):
                uses.append(tuple(held))
                held = []
            held.append(i)
        uses.append(tuple(held))
        assert len(uses) == n and 0 < uses.count(tuple(plain)) < n
        cuts.add(tuple(uses))
        several |= set(uses)
    assert len(cuts) == 5 and len(several) > 8
    rng = np.random.default_rng(1)
    drawn = np.array([[piece_dropout.skipped(int(k), at, merge, int(0.1 * 2**64)) for at, merge in ((0, 5), (0, 6), (1, 5), (3, 900))] for k in rng.integers(0, 2**63, 20_000)])
    assert np.all(np.abs(drawn.mean(0) - 0.1) < 0.01)
    for a in range(4):
        for b in range(a):
            assert abs((drawn[:, a] & drawn[:, b]).mean() - 0.01) < 0.004


def test_licenses_deals_out_neither_terms_nor_products(spark, monkeypatch):
    """What is staged last is planned with one exchange by unit below the counts of its terms."""
    plans = []

    def seen(df, label, *args, **kwargs):
        if label == "licence-own":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, label, *args, **kwargs)

    import re

    from seamlode.llm.common import staged

    monkeypatch.setattr(licenses, "staged", seen)
    df = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b", "x")], "doc_id long, path string, text string")
    got = {r["id"]: (r["license"], r["origin"]) for r in licenses.detect(df).collect()}
    assert got == {1: ("MIT", "header"), 2: ("MIT", "inherited")}
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plans[0])
    assert dealt and not any(re.search(r"\bt#|template#\d+, license#\d+, size", d) and "unit#" in d for d in dealt)
