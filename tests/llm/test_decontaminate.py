import random
import re

from roadlines.llm import decontaminate as dc


def best_distance(item, text):
    """Least edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != t))
    return min(row)


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s))
        s = rng.choice([s[:i] + s[i + 1:], s[:i] + "q" + s[i:], s[:i] + "zé"[i % 2] + s[i + 1:]])
    return s


def tables(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(["the", "of", "ing", "tion", "ban", "ore"]) + str(rng.randrange(30)) for _ in range(n))
    items = [(i, say(rng.choice([8, 12, 30]))) for i in range(25)] + [(90, "short"), (91, None), (92, ""), (None, say(12))]
    docs = []
    for i in range(120):
        item = rng.choice(items[:25])[1]
        n = rng.choice([0, 0, 1, 2, 4, 7, 9, 14])
        body = edited(rng, item, n).replace(" ", rng.choice([" ", "\n ", "  "]))
        docs.append((i, f"{say(20)} {body.upper() if i % 3 == 0 else body} {say(5)}" if i % 4 else say(60)))
    docs += [(204, "Quite  SHORT."), (205, "shorter and ashort"), (206, "shorter, short"), (200, None), (201, ""), (202, items[0][1] * 3), (202, items[0][1] * 3), (None, items[1][1]), (203, "a" * 100_000)]
    return docs, items


def test_against_brute_force(spark, docs_of):
    docs, items = tables(spark)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = dc.matches(docs_of(docs), bench).collect()
    want = []
    for d, t in docs:
        for i, item in items:
            n = dc.normal(item)
            if 0 < len(n) < dc.MIN_CHARS:
                if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", dc.normal(t)):
                    want.append((d, i, 0))
            elif n and t and len(t) < 50_000:
                k = best_distance(n, dc.normal(t))
                if k <= dc.budget(len(n)):
                    want.append((d, i, k))
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == sorted(want, key=str)
    left = dc.clean(docs_of(docs), bench)
    assert left.columns == docs_of(docs).columns
    bad = {d for d, _, _ in want}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_blocks_and_empty_tables(spark, docs_of, monkeypatch):
    docs, items = tables(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, dc.matches(docs_of(docs[:20]), bench).collect()))
    monkeypatch.setattr(dc.item_blocks, "__defaults__", (200,))
    assert sorted(map(str, dc.matches(docs_of(docs[:20]), bench).collect())) == whole
    assert dc.matches(docs_of(docs), bench.limit(0)).count() == 0
    assert dc.matches(docs_of(docs).limit(0), bench).count() == 0
    assert dc.clean(docs_of(docs[:5]), bench.limit(0)).count() == 5


def test_short_items_stand_alone(spark, docs_of):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "42"), (3, "?"), (4, "  ")], "item_id long, text string")
    docs = docs_of([(1, "Quiz: what is  the CAPITAL of France? Paris."), (2, "142 and 421"), (3, "42"), (4, "(42)"),
                    (5, "so what?")]).withColumn("_leak", dc.F.lit("mine"))
    got = {(r.doc_id, r.item_id, r.distance) for r in dc.matches(docs, bench).collect()}
    assert got == {(1, 1, 0), (1, 3, 0), (3, 2, 0), (4, 2, 0), (5, 3, 0)}
    left = dc.clean(docs, bench).collect()
    assert [(r.doc_id, r._leak) for r in left] == [(2, "mine")]
