"""Operators on pairs, against brute force: n-gram Jaccard join, nearest neighbours, components."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagraph.llm import common, ngram_jaccard, onebit_ann
from pelagraph.operators import joins

SCHEMA = "doc_id long, text string, n long, key string"


def shingles(text):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.2:
            t = r.choice(texts)
        elif texts and kind < 0.6:  # a near copy: a few words changed, so that similarities lie around the threshold
            w = r.choice(texts).split()
            for _ in range(r.randrange(1, 2 + len(w) // 25)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            t = " ".join(w)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 6, 40, 90, 200]))]
            t = " ".join(w[:20] + passage + w[20:] if r.random() < 0.4 else w)
        texts.append(t)
        rows.append((i * 3 % n + 1000 * (i % 2), t))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("seed,frequent", [(1, 500_000), (2, 500_000), (3, 20), (4, 0)])
def test_jaccard_same_as_brute_force(spark, seed, frequent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(df, frequent=frequent).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("small", [1, 3])
def test_jaccard_blocks_same_as_one_block(spark, monkeypatch, small):
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_DOCS", 3)
    monkeypatch.setattr(ngram_jaccard, "SMALL", small)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 2)
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_ROWS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_jaccard_large_group_and_boilerplate(spark):
    """More near copies, and more texts of one boilerplate, than a shingle may have to give pairs."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(90):  # near copies whose mutual similarity lies about the threshold
        w = list(base)
        for _ in range(r.choice([1, 1, 2])):
            w[r.randrange(80)] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    boiler = [f"p{i}" for i in range(60)]
    for i in range(90):  # texts that are mostly boilerplate, some linked
        rows.append((100 + i, " ".join(boiler + [f"q{r.randrange(10**6)}" for _ in range(r.choice([4, 12, 15, 25]))])))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_shared_passages_give_few_pairs(spark, monkeypatch):
    """Unlinked texts of sentences that about three others quote: pairs follow the shared shingles, not the tied texts."""
    r = random.Random(4)
    sentences = [" ".join(f"v{r.randrange(3000)}" for _ in range(12)) for _ in range(4000)]
    rows = [(i, " ".join(r.choice(sentences) for _ in range(20)), 0, "x") for i in range(600)]
    seen = []
    linked = ngram_jaccard._Texts.linked

    def counting(self, pairs, name):
        seen.append(pairs.count())
        return linked(self, pairs, name)

    monkeypatch.setattr(ngram_jaccard._Texts, "linked", counting)
    monkeypatch.setattr(ngram_jaccard, "_dense", lambda *a: pytest.fail("no shingle here is in so many texts"))
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(x.component_id == x.doc_id for x in got) and len(got) == 600
    assert len(seen) == 2 and max(seen) <= 600


def test_components_of_a_star_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(joins, "HUBS", 3)
    edges = [(5, 100 + i) for i in range(400)] + [(100 + i, 900 + i) for i in range(0, 400, 7)] + [(1, 5), (2000, 2001)]
    got = dict(common.components(spark.createDataFrame(edges, "x long, y long").repartition(5), "x", "y").collect())
    assert {v for k, v in got.items() if k < 2000} == {1} and got[2001] == 2000


def test_keep_one_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "a b", 7, 8, 9), (2, "c", 7, 8, 9)], "doc_id long, text string, _gone int, _Stay int, first int")
    assert sorted((x.doc_id, x.text) for x in ngram_jaccard.keep_one(df).collect()) == [(1, "a b"), (2, "c")]


def test_jaccard_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None, 1, "a"), (2, "", 1, "a"), (3, " \t\n", 1, "a"), (4, "A b", 1, "a"), (5, "a  B", 1, "a"), (5, "a b", 1, "a"), (None, "a b", 1, "a"), (6, long, 1, "a"), (7, long + " end", 1, "a")]
    got = sorted((tuple(r) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 29_996, 6), (7, 29_997, 6), (None, 1, None)]
    assert got == sorted(want, key=str)
    assert ngram_jaccard.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keep_one(spark):
    rows = [(3, "a b", 1, "k"), (1, "a b", 1, "k"), (2, "c", 1, "k"), (2, "c", 1, "k"), (None, "a b", 1, "k"), (9, None, 1, "k")]
    got = ngram_jaccard.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "n", "key"]
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 2, 9, None]


def test_keep_one_tells_rows_of_an_id_apart(spark):
    rows = [(1, "a b", 1, "k"), (2, "a b", 1, "k"), (2, "own text", 1, "k"), (2, "", 1, "k"), (2, None, 1, "k"), (2, "own  TEXT", 1, "k"), (3, "x", 1, "k"), (3, "y", 1, "k"), (4, "y", 1, "k"), (None, "y", 1, "k"), (5, "z", 2, "k"), (5, "z", 1, "k"), (0, "w", 1, "k"), (6, "w", 1, "k")]
    got = ngram_jaccard.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = [(1, "a b", 1, "k"), (2, "own  TEXT", 1, "k"), (2, None, 1, "k"), (3, "x", 1, "k"), (3, "y", 1, "k"), (None, "y", 1, "k"), (5, "z", 1, "k"), (0, "w", 1, "k")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_prefixes_of_linked_sets_share_what_is_asked():
    r = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**62, r.integers(5, 200)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(0, 2**62, 5).astype(np.uint64)]))
        common_ = len(np.intersect1d(a, b))
        if 100 * common_ < 75 * (len(a) + len(b) - common_):
            continue
        known = {int(x): int(r.integers(1, 99)) for x in np.concatenate([a, b]) if r.random() < 0.5}
        freq = lambda s: np.array([known.get(int(x), 0) for x in s])  # noqa: B023, E731
        (pa, ma), (pb, mb) = ngram_jaccard.prefix(a, freq(a)), ngram_jaccard.prefix(b, freq(b))
        assert len(np.intersect1d(pa, pb)) >= min(ma, mb)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(common.components(spark.createDataFrame(edges, "x long, y long").repartition(4), "x", "y").collect())
    assert all(got.get(x, x) == find(x) for x in list(root))


VEC = "vec_id long, embedding array<float>, dim long, label int"


def test_neighbours_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows}
    got = onebit_ann.nearest(df, F.col("vec_id") % 20 == 0, block=100, queries=7, pass_bytes=9_000).collect()
    by = {}
    for r in got:
        assert abs(r.score - float((x[r.query_id] * x[r.vec_id]).sum())) < 1e-12
        by.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hit = total = 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted((i for i in x if i != q), key=lambda i: (-(x[q] * x[i]).sum(), i))[:20]
        assert sorted(by[q]) == list(range(1, 21))
        hit, total = hit + len(set(want) & set(by[q].values())), total + 20
    assert hit / total >= 0.97


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 9, 1), (1, [1.0, 0.0], 9, 1), (2, [1.0, 0.0], 9, 1), (3, [0.0, 1.0], 9, 1), (4, [0.0, 0.0], 9, 1), (5, None, 9, 1), (6, [nan, 1.0], 9, 1), (7, [None, 1.0], 9, 1), (8, [], 9, 1), (None, [1.0, 1.0], 9, 1), (20, [2.0], 9, 1), (40, [3.0], 9, 1), (1, [1.0, 0.0], 9, 1)]
    got = onebit_ann.nearest(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (20, 1, 40, 6.0), (40, 1, 20, 6.0)]
    assert onebit_ann.nearest(spark.createDataFrame([], VEC), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("dim", [3, 64])
def test_estimates_are_unbiased_and_bounded(dim):
    r = np.random.default_rng(1)
    x, q = r.standard_normal((4000, dim)), r.standard_normal((1, dim))
    turn = onebit_ann.rotation(dim, onebit_ann.bits_for(dim))
    codes, norm, a, ones = onebit_ann.encode(x, turn)
    planes, scalars = onebit_ann.encode_queries(q, turn)
    est, width = onebit_ann.estimate(codes, norm, a, ones, planes[0], scalars[0])
    err, true = est - x @ q[0], np.abs(x @ q[0]).mean()
    assert codes.dtype == np.uint64 and codes.shape == (4000, onebit_ann.bits_for(dim) // 64)
    assert abs(err.mean()) < 0.05 * true and (np.abs(err) <= width).mean() > 0.97 and width.mean() < 3 * true


def test_packed_estimate_is_the_unpacked_product():
    r = np.random.default_rng(2)
    turn = onebit_ann.rotation(20, onebit_ann.bits_for(20))
    bits = turn.shape[1]
    x, q = r.standard_normal((50, 20)), r.standard_normal((3, 20))
    codes, norm, a, ones = onebit_ann.encode(x, turn)
    planes, scalars = onebit_ann.encode_queries(q, turn)
    sign = np.where(x @ turn > 0, 1, -1) / np.sqrt(bits)
    for j in range(3):
        u = sum(np.unpackbits(planes[j][p].view(np.uint8)).astype(int) << p for p in range(onebit_ann.PLANES))
        rounded = scalars[j][1] + scalars[j][2] * u
        assert np.abs(rounded - (q[j] / np.linalg.norm(q[j])) @ turn).max() <= scalars[j][2] / 2 + 1e-12
        want = sign @ rounded * norm / a * np.linalg.norm(q[j])
        assert np.abs(onebit_ann.estimate(codes, norm, a, ones, planes[j], scalars[j])[0] - want).max() < 1e-9


def test_equal_vectors_in_several_blocks(spark):
    """All scores equal: the smaller ids win, in whatever blocks they are."""
    df = spark.createDataFrame([(i, [0.6, 0.8], 1, 1) for i in range(60)], VEC)
    got = onebit_ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, block=7, queries=1).collect()
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, n + 1): v for q in (0, 20, 40) for n, v in enumerate([i for i in range(6) if i != q][:5])}


def test_few_vectors_are_reranked():
    """Bounds from packed bits leave most of a block's vectors alone, and lose few of the best."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 64)) * 2
    x = (centres[r.integers(0, 40, 4000)] + r.standard_normal((4000, 64))).astype("<f4")
    turn = onebit_ann.rotation(64, onebit_ann.bits_for(64))
    codes, norm, a, ones = onebit_ann.encode(x.astype(float), turn)
    planes, scalars = onebit_ann.encode_queries(x[:50].astype(float), turn)
    block = {"dim": 64, "ids": np.arange(4000).tobytes(), "x": x.tobytes(), "codes": codes.tobytes(), "scalars": np.stack([norm, a, ones], 1).astype(float).tobytes()}
    asked = {"dim": 64, "ids": np.arange(50).tobytes(), "x": x[:50].tobytes(), "codes": planes.tobytes(), "scalars": scalars.tobytes()}
    best = onebit_ann._Best(50, 20)
    assert onebit_ann.meet(block, asked, best, "<f4") < 50 * 4000 * 0.2
    hit = 0
    for j in range(50):
        s = x.astype(float) @ x[j].astype(float)
        s[j] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(best.ids[j].tolist()))
    assert hit >= 0.97 * 1000


def test_very_long_and_very_small_vectors(spark):
    df = spark.createDataFrame([(0, [1e30, 2e30], 1, 1), (1, [1e-30, 0.0], 1, 1), (2, [3e30, 1e30], 1, 1)], VEC)
    got = [(r.query_id, r.vec_id) for r in onebit_ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 2), (0, 1)]
