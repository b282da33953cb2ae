"""Merging lines writes few rounds, and opens rings in the same walk."""

import random

import pytest

from roadlines.functions.shapes import LINE_TYPE
from roadlines.operators import merge


@pytest.fixture
def written(monkeypatch):
    """The number of tables that a merge has written."""
    count = []
    real = merge.cut
    monkeypatch.setattr(merge, "cut", lambda df: count.append(1) or real(df))
    return count


def table(spark, lines):
    return spark.createDataFrame([("a", g) for g in lines], f"k string, g {LINE_TYPE}")


def ring(n, x=0.0):
    """A ring of n lines around (x, 0); the vertices are whole numbers along it."""
    nodes = [(x, float(i)) for i in range(n)]
    return [[nodes[i], (x + 1.0, i + 0.5), nodes[(i + 1) % n]] for i in range(n)]


def turned(lines, seed):
    rng = random.Random(seed)
    out = [g[::-1] if rng.random() < 0.4 else g for g in lines]
    rng.shuffle(out)
    return out


def test_long_chain_takes_few_rounds(spark, written):
    n = 200
    chain = [[(float(i), 0.0), (i + 1.0, 0.0)] for i in range(n)]
    [row] = merge.merge_lines(table(spark, turned(chain, 4)), ["k"], "g").collect()
    assert [p["x"] for p in row["geom"]] == [float(i) for i in range(n + 1)]
    # lines, links, first pointers, and rounds of 4, 16, 64, 256 steps: doubling would take eight
    assert len(written) <= 3 + 4


@pytest.mark.parametrize("n", [2, 3, 5, 33])
def test_ring_begins_and_ends_at_one_node(spark, n):
    [row] = merge.merge_lines(table(spark, turned(ring(n), n)), ["k"], "g").collect()
    got = [(p["x"], p["y"]) for p in row["geom"]]
    assert got[0] == got[-1] and len(got) == 2 * n + 1
    steps = {frozenset(s) for s in zip(got, got[1:])}
    assert steps == {frozenset(s) for g in ring(n) for s in zip(g, g[1:])}


def test_rings_and_chains_of_all_lengths_together(spark, written):
    lines, sizes = [], []
    for i, n in enumerate([2, 7, 20]):
        lines += ring(n, x=100.0 * i)
        sizes.append(2 * n + 1)
    for i, n in enumerate([1, 2, 4, 5, 6, 21]):
        lines += [[(float(j), 1000.0 + i), (j + 1.0, 1000.0 + i)] for j in range(n)]
        sizes.append(n + 1)
    rows = merge.merge_lines(table(spark, turned(lines, 9)), ["k"], "g").collect()
    assert sorted(len(r["geom"]) for r in rows) == sorted(sizes)
    assert len(written) <= 3 + 4
