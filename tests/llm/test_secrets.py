import hashlib
import random
import re

from roadlines.llm import secrets
from roadlines.llm.queries import op2_secrets

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)


def brute(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_base_spans_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = op2_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))


def test_base_spans_of_odd_texts(spark, docs_of):
    rng = random.Random(5)
    bits = ["token", "Secret", "api_key", "APIKEY", "=", ": ", " ", '"', "'", "abcdefgh", "a" * 40, "0f" * 16, "AKIA",
            "AKIAABCDEFGH1234", "é", "\U0001f600", "\n", "ſecret", "passwd", "x" * 7, "Q7dk2Lm9Xv4Tz8Rb1Nc6"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += [None, "", "token=token=abcdefgh", "token: secret: abcdefghi", "token = " + "z" * 200_000, "ab" * 100_000]
    rows = [(i, t, None, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(None, "token=abcdefgh1"), (0, texts[0], None, "s0")]
    got = secrets.scan(docs_of(rows)).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, tuple((x.kind, x.start, x.end) for x in r.spans if x.kind in secrets.BASE)) for r in got}
    assert found == {(r[0], tuple(brute(r[1] or ""))) for r in rows}
    for r in got:
        base = [(x.start, x.end) for x in r.spans if x.kind != "opaque"]
        assert not [x for x in r.spans if x.kind == "opaque" and any(s < x.end and x.start < e for s, e in base)]


def test_owners_separate_copies_from_live_values(docs_of):
    shared, own = "Qw9rTy7uIo5pAs3dFg1hJk", "Zx8cVb6nMa4sDf2gHj0kLq"
    rows = [(i, f"see {shared} here", None, f"o{i}") for i in range(5)] + [(9, f"see {own} and AKIAABCDEFGH1234", None, "o1")]
    got = {r.doc_id: r.spans for r in secrets.scan(docs_of(rows)).collect()}
    assert all(not got[i] for i in range(5))
    assert [(x.kind, x.live, x.owners) for x in got[9]] == [("opaque", True, 1), ("access", True, 1)]


def test_empty_table(docs_of):
    assert secrets.scan(docs_of([]).limit(0)).count() == 0
