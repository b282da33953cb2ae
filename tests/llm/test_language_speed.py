"""Words are scored by the pieces that stand in them, words of all lengths at once."""

import random
import time

import numpy as np
import public_tokenizers

from roadlines.llm import language_id as li


def dense(words, at, table, longest):
    """Every start and size of every word, one word length at a time; `at` holds the ids of pieces."""
    none, unknown = len(at) + 1, len(at)
    out = np.empty((len(words), table.shape[1]))
    by_size = {}
    for k, word in enumerate(words):
        by_size.setdefault(len(word) + 1, []).append(k)
    for n, places in by_size.items():
        found = np.full((len(places), n, longest), none)
        for w, k in enumerate(places):
            word = "▁" + words[k]
            for i in range(n):
                for j in range(i + 1, min(n, i + longest) + 1):
                    found[w, i, j - i - 1] = at.get(word[i:j], none)
                if found[w, i, 0] == none:
                    found[w, i, 0] = unknown
        alpha = np.zeros((n + 1, len(places), table.shape[1]))
        alpha[0] = 1.0
        logs = np.zeros(alpha.shape[1:])
        for j in range(1, n + 1):
            least = max(0, j - longest)
            if j % longest == 0:
                top = np.maximum(alpha[least:j].max(axis=0), 1e-300)
                alpha[least:j] /= top
                logs += np.log(top)
            for i in range(least, j):
                alpha[j] += alpha[i] * table[found[:, i, j - i - 1]]
        out[places] = np.log(np.maximum(alpha[n], 1e-300)) + logs - n * np.log(li.SCALE)
    return out


def odd_words(pieces, number, seed):
    rng = random.Random(seed)
    plain = [p.strip("▁") for p in pieces if p != "▁"]
    return list({"".join(rng.choices(plain, k=rng.randint(1, 4))) for _ in range(number)} | {"漢字", "x", "ñandú"})


def model_of(languages):
    pieces = li.vocabulary_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return li.Model(languages, pieces, np.random.default_rng(5).dirichlet(np.ones(len(pieces)), len(languages)).T)


def numbered(model):
    _, table, longest = model.table()
    return {p: i for i, p in enumerate(model.pieces)}, table, longest


def test_scores_of_a_few_words_cost_less_than_a_pass_over_all_starts_and_sizes():
    model = model_of(("a", "b", "c", "d"))
    groups = [odd_words(model.pieces, 400, seed) for seed in range(4)]
    spent, got = {}, {}
    for _ in range(3):
        for score, args in ((dense, numbered(model)), (li.score_words, model.table())):
            start = time.process_time()
            got[score] = [score(g, *args) for g in groups]
            spent[score] = min(spent.get(score, np.inf), time.process_time() - start)
    assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(got[dense], got[li.score_words], strict=True))
    assert spent[li.score_words] * 2 < spent[dense], spent


def test_long_words_and_slices_of_any_width_give_the_same(monkeypatch):
    model = model_of(("a", "b"))
    table = model.table()
    words = [*odd_words(model.pieces, 60, 9), "ab" * 500, "the" * 200, "z" * 333, "ü"]
    want = dense(words, *numbered(model))
    for places in (1, 700, 200_000):
        monkeypatch.setattr(li, "PLACES", places)
        assert np.allclose(li.score_words(words, *table), want, rtol=1e-12)
    bare = li.Model(("a",), (), np.zeros((0, 1)))
    assert np.allclose(li.score_words(["ab", "c"], *bare.table()), dense(["ab", "c"], *numbered(bare)))


def test_a_cache_that_fills_all_the_time_changes_no_prediction(spark, docs_of, monkeypatch):
    docs = docs_of([(i, f"the cat sat on the mat number {'abcdefgh'[i % 8] * 3}", "en") for i in range(200)]
                   + [(900 + i, f"der hund und die katze {'abcdefgh'[i % 8] * 3}", "de") for i in range(200)])
    model = li.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))

    def said():
        return sorted((r.doc_id, r.lang_pred, round(r.score, 12)) for r in li.predict(docs.coalesce(1), model).collect())

    want = said()
    for name, value in (("CACHED_BYTES", 1), ("TEXTS", 3), ("TOKENS", 2)):
        monkeypatch.setattr(li, name, value)
    assert said() == want
