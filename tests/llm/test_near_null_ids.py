import random

from roadlines.llm import near_dedup as nd
from test_near_dedup import edited


def test_near_pairs_of_rows_without_id_and_of_repeated_ids(docs_of):
    rng = random.Random(3)
    firsts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(firsts)]
    rows += [(None, edited(rng, t, 1)) for t in firsts[:6]] + [(99, edited(rng, t, 1)) for t in firsts[6:]]
    got = nd.near_duplicates(docs_of(rows)).collect()
    assert sorted(r.component_id for r in got if r.doc_id is None) == list(range(6))
    assert sorted(r.component_id for r in got if r.doc_id == 99) == list(range(6, 12))
    assert sorted(r.doc_id for r in got if r.kept) == list(range(12))
