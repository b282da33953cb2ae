import random

from roadlines.llm import line_dedup


def alike(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1:] == b[p + 1:] or a[p:] == b[p + 1:] or a[p + 1:] == b[p:]


def brute(rows, least=20):
    """rows in order; each text's lines without those that have an alike line before them."""
    seen, out = [], []
    for i, t in rows:
        kept = []
        for line in (t or "").split("\n"):
            if len(line) >= least:
                if not any(alike(line, s) for s in seen):
                    kept.append(line)
                seen.append(line)
            else:
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept)))
    return out


def edit(rng, line):
    i = rng.randrange(len(line) + 1)
    c = rng.choice("abé\U0001f600 ")
    return rng.choice([line[:i] + line[i + 1:], line[:i] + c + line[i:], line[:i] + c + line[i + 1:]])


def test_against_brute_force(docs_of):
    rng = random.Random(2)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.choice([19, 20, 21, 31, 32, 33, 64, 65, 200]))) for _ in range(60)]
    rows = []
    for i in range(160):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = edit(rng, line)
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 60_000), (204, "y" + "x" * 59_999), (205, "z")]
    rows.append((None, pool[0] + "\nlast of all, and without any id"))
    got = line_dedup.drop_repeated_lines(docs_of(rows), min_chars=20, exact_chars=20).collect()
    assert {(r.doc_id, r.text) for r in got} == set(brute(rows))
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"lang", "h1", "_row", "n_lines", "n_removed"}
    text = dict(rows)
    for r in got:
        assert r.n_lines == len((text[r.doc_id] or "").split("\n"))


def test_repeated_rows_and_empty_table(docs_of):
    line = "a line that is long enough to count"
    got = line_dedup.drop_repeated_lines(docs_of([(1, line), (1, line), (2, line + "!")])).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == [(1, line, 0), (1, line, 0), (2, "", 1)]
    assert line_dedup.drop_repeated_lines(docs_of([(1, line)]).limit(0)).count() == 0
