import corpus_pipeline as cp
from roadlines.llm import decontaminate as dc
from test_near_dedup import brute as brute_components
from test_short_lines import brute as brute_lines


def test_stages_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()
    for name, stage in cp.STAGES:
        rows = cp.cut(stage(spark, docs, sf))
        if name != "byte-level BPE":
            assert rows.columns == list(cp.COLUMNS)
        got, pairs = rows.collect(), sorted((r.doc_id, r.text) for r in before)
        if name == "language id":
            assert {r.doc_id for r in got} <= {r.doc_id for r in before} and len(got) > 0.95 * len(before)
        elif name == "line dedup":
            assert {(r.doc_id, r.text) for r in got} == {p for p, old in zip(
                brute_lines(pairs, cp.ALIKE_CHARS), pairs, strict=True) if p[1].strip() or p == old}
            assert all(r.n_chars == len(r.text) for r in got)
        elif name == "near dedup":
            assert {r.doc_id for r in got} == {d for d, _, _, kept in brute_components(pairs) if kept}
        elif name == "decontamination":
            left = {r.doc_id for r in got}
            for d, t in pairs:
                exact = any(dc.normal(b) in dc.normal(t) for b in bench)
                assert not (exact and d in left)
            assert len(left) > 0.8 * len(pairs)
        else:
            assert len(got) == len(before) and all(r.round_trip for r in got)
        docs, before = rows, got


def test_run(spark):
    assert {"ids", "doc_id"} <= set(cp.run(spark, "/root/testdata/sf0.001").columns)
