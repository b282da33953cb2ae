import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlines.llm import near_dedup as nd
from roadlines.session import ensure_checkpoint_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_sets_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", "é", "É", " ", "\n", "\x0b", " ", "the ", "\U0001f600"]) for _ in range(rng.randint(0, 60)))
        assert len(nd.shingle_set(text.encode())) == len(shingles(text))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2400]), np.unique(pool[600:])
    sig = nd.signatures([a, b, a[:1]])
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1
    assert (nd.band_keys(sig)[0] == nd.band_keys(sig)[1]).any()


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def cases():
    rng = random.Random(7)
    rows, d = [], 0
    for _ in range(25):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 9, 40, 120, 300])))
        group = [base]
        for _ in range(rng.choice([0, 1, 4, 12])):
            group.append(rng.choice([rng.choice(group), edited(rng, rng.choice(group), rng.choice([1, 1, 2, 3])), base.upper()]))
        for t in group:
            rows.append((d, t))
            d += 1
    ids = list(range(d))
    rng.shuffle(ids)
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]
    return rows + [(d, None), (d + 1, ""), (d + 2, " \n"), (d + 3, "one"), (d + 4, "ONE"), (d + 5, "word " * 40_000)]


def test_components_equal_brute_force(docs_of):
    rows = cases()
    got = nd.near_duplicates(docs_of(rows)).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_drifting_chain_of_copies_stays_whole(docs_of):
    rng = random.Random(9)
    text, rows = " ".join(f"w{i}" for i in range(200)), []
    for i in range(60):
        rows.append((i, text))
        text = edited(rng, text, 2)
    rng.shuffle(rows)
    assert sorted(map(tuple, nd.near_duplicates(docs_of(rows)).drop("text_hash").collect())) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    got = nd.near_duplicates(docs_of([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "x")])).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(5, 1, 5, True), (5, 1, 5, True), (None, 1, 5, False), (None, 1, None, True)], key=str)
    assert nd.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (3, 4), (9, 4), (5, 6)], [(i, i + 1) for i in range(1, 40)]])
def test_components(spark, edges):
    nodes = spark.range(1, 45).select("id")
    got = {r.id: r.root for r in nd.components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: i for i in range(1, 45)}
    for _ in want:
        for u, v in edges:
            if u in want and v in want:
                want[u] = want[v] = min(want[u], want[v])
    assert got == want


def test_keep_one(docs_of):
    rows = [(5, "a b c"), (5, "a b c"), (3, "A b  c"), (None, "a b c"), (7, None), (8, ""), (9, "d e")]
    got = nd.keep_one(docs_of(rows))
    assert got.columns == docs_of(rows).columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, "A b  c"), (7, None), (8, ""), (9, "d e")]


def test_large_buckets_are_spread_without_losing_a_link(docs_of, monkeypatch):
    monkeypatch.setattr(nd, "MEETING", 2)
    rows = cases()
    assert sorted(map(tuple, nd.near_duplicates(docs_of(rows)).drop("text_hash").collect())) == brute(rows)


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_sets_that_can_be_alike_have_neighbouring_levels(spark, percent):
    pairs = spark.range(1, 400).withColumn("m", F.explode(F.sequence("id", F.floor(F.col("id") * 100 / percent))))
    off = pairs.where(F.abs(nd.size_level(F.col("id"), percent) - nd.size_level(F.col("m"), percent)) > 1)
    assert off.count() == 0


def test_rounds_leave_one_written_table(spark):
    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("cut-*"))
    roots = nd.components(spark.range(1, 45).select("id"), spark.createDataFrame([(i, i + 1) for i in range(1, 44)], "u long, v long"))
    assert len(set(folder.glob("cut-*")) - before) == 1
    assert {r.root for r in roots.collect()} == {1}
