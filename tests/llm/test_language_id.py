import zlib

import numpy as np
import public_tokenizers

from roadlines.llm import language_id as li
from roadlines.llm.queries import op4_language_id

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def tiny():
    pieces = ("a", "ab", "b", "▁", "▁a")
    return li.Model(("x", "y"), pieces, np.array([[.1, .3], [.2, .1], [.3, .2], [.1, .1], [.3, .3]]))


def brute(word, model, k):
    """Sum over all segmentations, written out."""
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        p = word[:j]
        if p in model.pieces:
            total += model.probabilities[model.pieces.index(p), k] * brute(word[j:], model, k)
        elif j == 1:
            total += li.UNKNOWN * brute(word[j:], model, k)
    return total


def test_forward_sums_all_segmentations():
    model = tiny()
    ids, table, longest = model.table()
    words = ["a", "ab", "abab", "bbab", "zab", "aaabbbab", "ab" * 6]
    got = li.score_words(words, ids, table, longest)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [np.log(brute("▁" + w, model, k)) for k in (0, 1)])
    long = li.score_words(["ab" * 5000], ids, table, longest)
    assert np.isfinite(long).all()
    half = li.score_words(["ab" * 2500], ids, table, longest)
    quarter = li.score_words(["ab" * 1250], ids, table, longest)
    assert np.allclose(long - half, 2 * (half - quarter), rtol=1e-3)


def test_expected_counts_are_log_derivatives():
    model = tiny()
    ids, table, longest = model.table()
    col = np.ascontiguousarray(table[:, 0])
    got = li.expected_counts(["abab", "ba"], np.array([2.0, 1.0]), ids, col, longest)
    for p in range(len(model.pieces)):
        bumped = table.copy()
        bumped[p, 0] *= 1 + 1e-6
        change = li.score_words(["abab", "ba"], ids, bumped, longest)[:, 0] - li.score_words(["abab", "ba"], ids, table, longest)[:, 0]
        assert np.isclose(got[p], (change * [2, 1]).sum() / 1e-6, atol=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == truth[r.doc_id][1])
    assert sum(right) / len(right) > 0.95


def test_odd_texts(spark, docs_of):
    docs = docs_of([(i, "the cat sat on the mat and the dog", "en") for i in range(9)]
                   + [(20 + i, "der hund und die katze sind nicht da", "de") for i in range(9)] + [(40, "x", None)])
    model = li.fit(docs, MODEL)
    assert model.languages == ("de", "en")
    odd = docs_of([(1, None), (1, None), (2, ""), (3, "12 ²½ !"), (4, "Der Hund"), (None, "the dog"), (6, "漢字"), (7, "a" * 100_000)])
    got = sorted(((r.doc_id, r.lang_pred, r.h1) for r in li.predict(odd.withColumn("score", odd.h1), model).collect()), key=str)
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 4
    assert (4, "de", "y") in got and (None, "en", "y") in got and len(got) == 8
    empty = li.fit(docs.limit(0), MODEL)
    assert empty.languages == () and {r.lang_pred for r in li.predict(odd, empty).collect()} == {"und"}
    assert li.predict(odd.limit(0), model).count() == 0
