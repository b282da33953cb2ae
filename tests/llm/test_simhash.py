"""SimHash and BK-trees against hashing and comparing everything with everything."""

import random

import numpy as np
import pytest
import xxhash

from roadlines.llm import simhash as sh
from roadlines.llm.common import join_skewed


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    lines = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(x, seed=42).intdigest() for x in lines]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """fps: list of (id, fingerprint) -> least id of each row's component."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(fps))]


def test_fingerprint_of_any_text():
    rnd = random.Random(1)
    texts = ["", " \t\x0b ", "One", "a B", "a b c", "A B C d e", "x " * 20_001, "Ünï ÇA\x1c b c d",
             " ".join(rnd.choice("abcdefgh") for _ in range(9000))]
    for t in texts:
        assert sh.simhash(t.encode()) == slow_fingerprint(t)
    assert sh.simhash(b"") == 0


def test_tree_finds_all_within_the_radius():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(1) << np.uint64(k) for k in range(64)]
    fps = np.unique(np.concatenate([base, np.array([0, (1 << 64) - 1], np.uint64), *[
        base ^ rnd.choice(flips, 40) ^ rnd.choice(flips, 40) for _ in range(6)]]))
    rnd.shuffle(fps)
    parent, edge = sh.grow(fps)
    assert parent[0] == -1 and (parent[1:] >= 0).all()
    assert (np.bitwise_count(fps[1:] ^ fps[parent[1:]]) == edge[1:]).all()
    assert len({(p, e) for p, e in zip(parent[1:], edge[1:], strict=True)}) == len(fps) - 1  # one child on an edge
    tree = sh.Tree(fps, parent, edge)
    for radius in (0, 2, 5):
        got = {(int(q), int(n)) for part in tree.within(fps, radius) for q, n in zip(*part, strict=True)}
        assert got == {(i, j) for i in range(len(fps)) for j in range(len(fps))
                       if int(fps[i] ^ fps[j]).bit_count() <= radius}
    one = sh.Tree(fps[:1], *sh.grow(fps[:1]))
    assert [p[0].tolist() for p in one.within(fps[:1], 0)] == [[0]]


@pytest.mark.parametrize("shard", [1 << 17, 7])
def test_components_equal_brute_force(spark, docs_of, monkeypatch, shard):
    monkeypatch.setattr(sh, "FRONTIER", 16)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (None, "one"), (5, "one"), (5, "one"), (6, "two words")]
    for i in range(7, 60):
        text = [rnd.choice(words) for _ in range(rnd.choice([3, 40, 2000]))]
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            text[rnd.randrange(len(text))] = "other"
            rows.append((i + 100, " ".join(text)))
    rows.append((None, "quite alone here with nobody near by at all"))
    monkeypatch.setattr(sh.links, "__defaults__", (2, shard))
    got = sh.near_duplicates(docs_of(rows))
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    want = [(d, f, c) for (d, f), c in zip(fps, slow_components(fps), strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got.collect()), key=order)
    assert have == sorted(want, key=order)
    assert len({c for *_, c in want}) < len(want) - 8


def test_empty_table(spark, docs_of):
    assert sh.near_duplicates(docs_of([])).columns == ["doc_id", "fp", "component_id"]
    assert sh.near_duplicates(docs_of([])).count() == 0


def test_hot_keys_are_joined_whole(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 2500, 0, id) as k")
    looked = rows.groupBy("k").count().selectExpr("k", "k * 2 as v", "count as n")
    got = join_skewed(rows, looked, "k", share=10)
    assert got.count() == 3000 and got.where("v != k * 2").count() == 0
