"""Hard negatives against scoring every anchor with every row."""

import math

import numpy as np
import pytest

from roadlines.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector int, node int"
BIG = (1 << 63) - 1


def ints(v, width):
    return [math.floor(256 * x) for x in v] + [0] * (width - len(v))


def slow(rows, every=5, positives=5, negatives=10, low=30, high=90):
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    good = [(i, ints(v, width), c) for i, v, c in rows
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_id = {}
    for i, v, c in good:
        if i is not None and i % every == 0:
            by_id[i] = min(by_id.get(i, (c, v)), (c, v))
    out = []
    for a, (label, vector) in by_id.items():
        def first(n, test, a=a, vector=vector):
            got = [(max(-BIG, min(BIG, sum(p * q for p, q in zip(vector, v, strict=True)))), i, c) for i, v, c in good if i != a]
            got = [g for g in got if test(g)]
            return sorted(got, key=lambda g: (-g[0], g[1] is None, g[1] or 0))[:n]

        for s, p, _ in first(positives, lambda g, label=label: g[2] == label):
            best = first(negatives, lambda g, label=label, s=s: g[2] != label and low * s <= 100 * g[0] <= high * s)
            out += [(a, p, k + 1, n, s, t) for k, (t, n, _) in enumerate(best)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, rows, every=5, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = hn.mine(df, lambda i: i % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    options.pop("block", None)
    want = slow(rows, every, **options)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    return want


def clustered(seed, n, width=12, spread=0.1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, width))
    return [(i, (centres[rnd.integers(6)] + spread * rnd.normal(size=width)).tolist(), int(rnd.integers(3))) for i in range(n)]


def test_clusters_in_one_block_and_many(spark):
    rows = clustered(1, 160)
    assert len(check(spark, rows)) > 500
    check(spark, rows, block=7, positives=2, negatives=3, low=10, high=70)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = clustered(2, 50, 4)
    rows += [(50, None, 1), (51, [1.0, 2.0, 3.0, 4.0], None), (52, [1.0, None, 0.0, 0.0], 1), (53, [1.0, float("nan"), 0.0, 0.0], 1),
             (54, [float("inf"), 0.0, 0.0, 0.0], 1), (55, [1.0, 1.0], 1), (56, [], 0), (60, [], 1), (65, [0.0] * 4, 2),
             (None, [1.0, 1.0, 1.0, 1.0], 1), (None, [2.0, 2.0, 2.0, 2.0], 0), (70, [-1.0] * 4, 1), (71, [1.0] * 4, 1), (80, [5.0] * 4, 7)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(100, 120)]
    rows += rows[3:9] + [(10, [0.1, 0.2, 0.3, 0.4], 0)]
    check(spark, rows)
    check(spark, rows, block=5)


def test_huge_components(spark):
    rows = [(i, [1e15 * (i % 7), 1e30 if i == 12 else float(i), 3.0], i % 2) for i in range(30)]
    check(spark, rows)


def test_tables_without_anchors(spark):
    assert check(spark, []) == [] and check(spark, [(1, [1.0], 1), (2, [1.0], 0)]) == []
    assert check(spark, [(5, [1.0], 1)]) == []


def test_tree_is_minimal_and_bounds_spare_products():
    rnd = np.random.default_rng(3)
    x = np.floor(256 * np.concatenate([c + 0.02 * rnd.normal(size=(15, 16)) for c in rnd.normal(size=(5, 16))]))
    parent, edge = hn.spanning_tree(x)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    pairs = sorted((far[i, j], i, j) for i in range(len(x)) for j in range(i))
    root, total = list(range(len(x))), 0.0
    for d, i, j in pairs:  # Kruskal
        a, b = root[i], root[j]
        if a != b:
            root, total = [a if r == b else r for r in root], total + d
    assert edge.sum() == pytest.approx(total) and parent[0] == -1
    assert np.allclose(edge[1:], far[np.arange(1, len(x)), parent[1:]])
    order = [k for k, _ in hn.downward(parent)]
    assert sorted(order) == list(range(len(x))) and all(order.index(parent[k]) < order.index(k) for k in range(1, len(x)))
    tree = {"id": np.arange(len(x)), "label": np.zeros(len(x), int), "x": x, "parent": parent, "edge": edge}
    candidates = np.floor(256 * rnd.normal(size=(4000, 16)))
    top = int((x @ candidates.T).max())
    search = hn.Search(tree, [[(top * 9 // 10, top)] for _ in x], 10, False)
    search.add(candidates, np.arange(1000, 5000), np.ones(4000, int))
    assert 0 < search.rescored < 0.2 * 4000 * len(x)
    for k in range(len(x)):
        scores = (candidates @ x[k]).astype(int)
        inside = sorted((-s, i + 1000) for i, s in enumerate(scores.tolist()) if top * 9 // 10 <= s <= top)[:10]
        s, i = search.best[k][0]
        assert [(-a, b) for a, b in zip(s.tolist(), i.tolist(), strict=True)] == inside
