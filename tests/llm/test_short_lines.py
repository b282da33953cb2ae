import random

import pytest

from roadlines.llm import line_dedup
from roadlines.llm.queries import op10_line_dedup
from test_line_dedup import alike


def brute(rows, least=1):
    """Exact repeats of any non-empty line go; alike lines only from `least` characters on."""
    seen, out = [], []
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            near = len(line) >= least and any(alike(line, s) for s in seen if len(s) >= least)
            if not (line and (line in seen or near)):
                kept.append(line)
            seen.append(line)
        out.append((i, None if t is None else "\n".join(kept)))
    return out


def test_short_repeats_go_and_short_alike_lines_stay(docs_of):
    edge = "x" * 19
    rows = [(1, f"Les.\nLet.\n\nLes.\n{edge}"), (2, f"Les.\n\nnew\n{edge}y"), (3, f"{edge}\nz\nz"), (4, None), (5, "")]
    got = line_dedup.drop_repeated_lines(docs_of(rows), min_chars=20).collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in got} == {
        (1, f"Les.\nLet.\n\n{edge}", 1), (2, f"\nnew\n{edge}y", 1), (3, "z", 2), (4, None, 0), (5, "", 0)}


def test_query_leaves_no_repeat(spark):
    sf = "/root/testdata/sf0.001"
    pairs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = {(r.doc_id, r.text) for r in op10_line_dedup(spark, sf).collect()}
    assert got == set(brute(pairs))
    lines = [x for _, t in got for x in (t or "").split("\n") if x]
    assert len(lines) == len(set(lines))


def test_short_alike_lines_go_at_one_character(docs_of):
    rng = random.Random(4)
    rows = [(i, "\n".join("".join(rng.choice("abcé😀") for _ in range(rng.choice([0, 1, 2, 3, 3, 4, 5, 8, 19])))
                          for _ in range(rng.randrange(4)))) for i in range(150)]
    got = line_dedup.drop_repeated_lines(docs_of(rows)).collect()
    assert {(r.doc_id, r.text) for r in got} == set(brute(rows))
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(docs_of(rows), min_chars=0)


def test_clashing_names(docs_of):
    docs = docs_of([(1, "same line"), (2, "same line")]).selectExpr(
        "*", "1 as _key", "2 as _th", "3 as _text", "4 as _null", "5 as key", "6 as th")
    got = line_dedup.drop_repeated_lines(docs).orderBy("doc_id").collect()
    assert [(r.text, r._key, r._th, r._text, r._null, r.key, r.th) for r in got] == [
        ("same line", 1, 2, 3, 4, 5, 6), ("", 1, 2, 3, 4, 5, 6)]
