"""Runs against trying every period at every place."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadlines.llm import periodic_runs as pr
from roadlines.llm import queries as q


def slow_runs(words, least=6):
    """Every maximal stretch of each period, those of a smaller period left out."""
    found, n = [], len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            size = j + p - i
            if size >= max(least, 4 * p) and not any(
                    all(words[k] == words[k + d] for k in range(i, i + size - d)) for d in range(1, p)):
                found.append((i, size, p))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(rnd, n):
    """Words in which stretches repeat, within one another too."""
    words = [rnd.choice("abc") for _ in range(rnd.randrange(1, 8))]
    while len(words) < n:
        at = rnd.randrange(len(words))
        size = rnd.randrange(1, min(60, len(words) - at) + 1)
        words += words[at:at + size] * rnd.randrange(1, 7) + [rnd.choice("abcdefgh") for _ in range(rnd.randrange(4))]
    return words[:n]


def check(texts, least=6):
    got = pr.runs_of([[w.encode() for w in t] for t in texts], least)
    for t, r in zip(texts, got, strict=True):
        assert list(map(tuple, r.tolist())) == slow_runs(t, least), t


def test_random_and_planted_texts():
    rnd = random.Random(5)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 400, list("ab" * 3), list("ab" * 4), list("abcabcabcabca"),
             list("aab" * 9 + "aac" * 5), list("abcde" * 50 + "x" + "abcde" * 3)]
    texts += [planted(rnd, rnd.randrange(1, 500)) for _ in range(150)]
    texts += [[rnd.choice("ab") for _ in range(rnd.randrange(200))] for _ in range(100)]
    check(texts)
    check(texts[:60], least=1)


def test_runs_of_every_period():
    rnd = random.Random(6)
    texts = []
    for p in range(1, 70):
        block = [str(rnd.randrange(1000)) for _ in range(p)]
        for size in (4 * p - 1, 4 * p, 4 * p + 1, 6 * p + 3):
            texts.append(["<"] * rnd.randrange(7) + (block * 8)[:size] + [">"] * rnd.randrange(7))
    check(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 8)), max_size=7))
def test_any_powers(parts):
    check([[w for block, k in parts for w in block * k]])


def test_groups_are_split_alike(monkeypatch):
    rnd = random.Random(7)
    texts = [planted(rnd, rnd.randrange(1, 300)) for _ in range(40)]
    monkeypatch.setattr(pr, "GROUP", 100)
    check(texts)


def test_long_texts_end_soon():
    rnd = random.Random(8)
    block = [str(rnd.randrange(10**6)) for _ in range(30_011)]
    t0 = time.time()
    long = [["a"] * 500_000, list("ab" * 250_000), (block * 9), planted(rnd, 300_000)]
    got = pr.runs_of([[w.encode() for w in t] for t in long])
    assert [r.tolist() for r in got[:3]] == [[[0, 500_000, 1]], [[0, 500_000, 2]], [[0, 9 * 30_011, 30_011]]]
    assert time.time() - t0 < 60


def test_find_on_a_table(spark, docs_of):
    rnd = random.Random(9)
    texts = [None, "", " \t\n", "a  a\ta\na a a", "A a A a A a A a", "x " * 3000 + "é " * 6] + [
        " ".join(planted(rnd, 90)) for _ in range(30)]
    docs = docs_of([(k, t) for k, t in enumerate(texts)] * 2).withColumn("periodic", F.lit(1))
    rows = pr.find(docs).select("doc_id", "_row", "periodic.*", pr.strongest(F.col("periodic.runs")).alias("best")).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        words = (texts[r.doc_id] or "").split()
        runs = slow_runs(words)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), runs, slow_collapsed(words, runs))
        want = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else None
        assert (tuple(r.best) if r.best else None) == want
    assert pr.find(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        pr.find(docs, least=0)


def test_query_equals_brute_force(spark, docs_of, tmp_path):
    rnd = random.Random(10)
    rows = [(k, None if k == 3 else "" if k == 4 else " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 120))))
            for k in range(200)]
    docs_of([*rows, (None, "a a a a a a b")]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in q.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == 201 and got[None].n_runs == 1
    changed = 0
    for k, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs, r = slow_runs(words), got[k]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(slow_collapsed(words, runs).encode()).hexdigest()
    assert changed > 10 and np.mean([r.n_runs > 0 for r in got.values()]) > 0.03
