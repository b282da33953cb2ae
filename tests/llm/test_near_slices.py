import hashlib

import numpy as np

from roadlines.llm import near_dedup as nd


def test_texts_of_several_slices_keep_their_places(spark):
    """One batch of more texts than a slice holds, with slices in which no text has words."""
    n = 2 * nd.TEXTS + 7
    texts = {i: None if i % 5 == 0 or nd.TEXTS <= i < 2 * nd.TEXTS else " ".join(
        hashlib.md5(f"{i}:{j}".encode()).hexdigest()[:6] for j in range(3 + i % 9)) for i in range(n)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").coalesce(1)
    sets = {i: nd.shingle_set((t or "").encode()) for i, t in texts.items()}
    got = {r.doc_id: r.s for r in nd.shingled(docs).collect()}
    assert got == {i: s.view(np.int64).tolist() for i, s in sets.items()}
    signs = {r.doc_id: r.sig for r in nd.signed(docs).collect()}
    assert all(signs[i].n == len(s) for i, s in sets.items())
    full = [i for i in texts if len(sets[i])]
    keys = nd.band_keys(nd.signatures([sets[i] for i in full]))
    assert all(signs[i].bands == k.view(np.int64).tolist() for i, k in zip(full, keys, strict=True))
    assert all(signs[i].bands == [] for i in texts if not len(sets[i]))
