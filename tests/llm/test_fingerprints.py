import hashlib

from pyspark.sql import functions as F

from roadlines.llm import fingerprints as fp
from roadlines.llm import queries


def brute(rows):
    """doc_id -> edited text, for unique ids."""
    order = sorted((i for i, _ in rows), key=lambda i: (i is None, -(i or 0)))
    text = {i: t or "" for i, t in rows}
    out = {}
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        t, half = text[i], len(text[i]) // 2
        out[i] = t[: len(t) - half] + text[after][:half]
    return out


def test_edited_text_and_sketches(docs_of):
    rows = [(i * 7 % 101, f"w{i} " * (i % 13) + "é\U0001f600x " * (i % 4) + f"tail {i} {i + 1}") for i in range(100)]
    rows += [(1000, None), (1001, ""), (None, "no id but five words and more"), (1003, "z " * 20_000)]
    got = fp.fingerprint_with_next(docs_of(rows)).collect()
    want = brute(rows)
    assert {r.doc_id: r.edited for r in got} == want and len(got) == len(rows)
    whole = {r[0]: r for r in got}
    again = fp.fingerprint_with_next(docs_of([(i, want[i]) for i, _ in rows])).collect()
    assert {r.doc_id: r.sketch for r in again} == {i: r.edited_sketch for i, r in whole.items()}
    assert all(r.sketch == sorted(set(r.sketch)) and len(r.sketch) <= fp.K for r in got)


def test_repeated_ids_stay(docs_of):
    got = fp.fingerprint_with_next(docs_of([(1, "a b"), (1, "a b"), (2, "c d e f")])).collect()
    assert sorted((r.doc_id, r.edited) for r in got) == [(1, "a c"), (1, "a c"), (2, "c d a b")]
    assert fp.fingerprint_with_next(docs_of([(1, "x")]).limit(0)).count() == 0


def test_estimates(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = words[:2000], words[1000:]
    df = spark.createDataFrame([(a, b, a + b)], "a array<string>, b array<string>, ab array<string>").select(
        *[fp.sketch(F.col(c)).alias(c) for c in ("a", "b", "ab")])
    r = df.select(fp.resemblance(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("a"), F.col("b")).alias("c"),
                  fp.distinct_count(F.col("a")).alias("n"), fp.resemblance(F.col("a"), F.col("a")).alias("one"),
                  (F.size(F.array_intersect("ab", fp.merge(F.col("a"), F.col("b"))))).alias("merged")).first()
    assert abs(r.j - 1 / 3) < 0.2 and abs(r.c - 0.5) < 0.25 and 1300 < r.n < 2700 and r.one == 1 and r.merged >= 60


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([tuple(r) for r in rows])
    for r in queries.op8_fingerprints(spark, sf).collect():
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
