import random

from roadlines.llm import url_filter
from roadlines.llm.queries import URL_RULES


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["Example.ORG", "a.b.example.org", "xexample.org", "org", "x.com", "com", "", "é.org", "example.org.", "u@h.com:80"]
    ends = ["", "/", "/en/1", "/en/123?x=/es/", "/es/", "/es", "/fr/#a", "/de/1", "?a://b", "#x", "/EN/1", "/en\n/1"]
    urls = [f"{s}{h}{e}" for s in ("http://", "//", "x://y://") for h in hosts for e in ends] + [None, "", "://", "a" * 50_000]
    rows = [(rng.choice([None, i]), u, "h", "p") for i, u in enumerate(urls)] + [(1, urls[3], "h", "p")] * 40
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = [*URL_RULES, ("org", "/en/", "allow"), ("org", "/en/", "block"), ("b.example.org", "/", "allow")]
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, df).collect()), key=key)
    assert got == sorted(((r[0], r[1], *brute(r[1], rules)) for r in rows), key=key)
    assert {r.verdict for r in url_filter.judge(pages, df.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), df).count() == 0
