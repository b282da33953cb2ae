from roadlines.llm import html_text
from roadlines.llm.html_text import extract

LONG = "It was the best of times and it was the worst of times, for all of them that had been there with us."


def test_containers_and_references():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">the one</a></li></ul></nav><div class="ad">{LONG}</div>
    <div id="cookie-notice"><p>{LONG}</p></div><!-- {LONG} --><article><h1>Head &amp; tail</h1><p><b>{LONG}<br>
    <p>Short &lt;one&gt; &#233;&nbsp;x.</p><aside>{LONG}</aside><form><p>{LONG}</p></form>
    <section class="comments"><p>{LONG}</p></section></article><footer>&copy; {LONG}</footer>"""
    assert extract(page) == f"Head & tail\n{LONG}\nShort <one> é x."


def test_without_containers_short_blocks_inherit():
    page = f"<body><p><a href=x>one two</a></p><p>Menu</p><p><a>x</a></p><p>{LONG}</p><p>So.</p><p>{LONG}</p></body>"
    assert extract(page) == f"{LONG}\nSo.\n{LONG}"


def test_odd_pages():
    assert extract("") == "" and extract("<p") == "<p" and extract("<p>") == ""
    assert extract("<script>" + "x" * 100) == ""
    assert extract("<article>" + "<b>" * 5000 + LONG) == LONG
    assert len(extract("<article>" + f"<p>{LONG}" * 3000).split("\n")) == 3000
    assert html_text.second_pass([], []) == []


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, f"<main><p>{LONG}</main>", "b")],
                                  "page_id long, html string, text string")
    got = html_text.main_text(pages).collect()
    assert sorted(r.text for r in got) == ["", "", LONG]


def test_articles_of_the_table(spark):
    from roadlines.llm.queries import op5_html_text
    import html
    import re
    sf = "/root/testdata/sf0.001"
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op5_html_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks]
        assert r.text == "\n".join(b for b in want if b), r.page_id
        assert r.n_chars == len(r.text)
