"""The two passes against a plain reading of their rules; pages that once hung or lost their text."""

import random
import time

from roadlines.llm import html_text as ht
from roadlines.llm.html_text import extract

ENGLISH = "It was the best of times and it was the worst of times, for all of them that had been there with us."
ITALIAN = ("Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir "
           "qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura!")
RUSSIAN = ("Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме "
           "Облонских. Жена узнала, что муж был в связи с бывшею в их доме француженкою-гувернанткой.")
JAPANESE = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。" * 3


def plain_labels(blocks, known):
    """Both passes, block by block, by looking left and right."""
    first = []
    for text, links, main, outer in blocks:
        words = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        density = len([w for w in words if w in ht.STOP_WORDS]) / max(1, len(words))
        if outer or (links > 0.5 and (not main or links >= 1)):
            first.append(False)
        elif len(text) >= 70 and (
                (main or len(text) >= 200) if not known else density >= 0.3 or (density >= 0.2 and (main or len(text) >= 200))):
            first.append(True)
        else:
            first.append(None)
    inside = [main and not outer for _, _, main, outer in blocks]
    labels = []
    for i, label in enumerate(first):
        if label is None:
            near = []
            for step in (-1, 1):
                k = i + step
                while 0 <= k < len(blocks) and inside[k] == inside[i] and first[k] is None:
                    k += step
                if 0 <= k < len(blocks) and inside[k] == inside[i]:
                    near.append(first[k])
            label = near[0] if near and len(set(near)) == 1 else inside[i]
        labels.append(label)
    if not any(labels):
        sizes = [len(t) for t, links, _, outer in blocks if not outer and links <= 0.5]
        labels = [not outer and links <= 0.5 and len(t) == max(sizes) for t, links, _, outer in blocks]
    return labels


def test_rules_on_random_pages():
    rng = random.Random(3)
    seen = set()
    for _ in range(1500):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            text = rng.choice([ENGLISH, ENGLISH * 3, "Menu", "So it was.", "x" * 250, "lorem ipsum " * 8, "lorem ipsum dolor " * 15, ITALIAN])
            inner = rng.choice([text, text, f"<a href=x>{text}</a>", f"{text} <a>{text[: rng.randrange(1, 60)]}</a>"])
            tag = rng.choice(["p", "p", "div", "li", "nav", "pre", "div class='sidebar'"])
            parts.append(f"<{tag}>{inner}</{tag.split()[0]}>")
            if rng.random() < 0.15:
                parts.append(rng.choice(["<article>", "</article>", "<main>", "</main>"]))
        page = "".join(parts)
        blocks = ht.blocks_of(page)
        known = any(len(t) >= 70 and links <= 0.5 and ht.stop_density(t) >= 0.2 for t, links, _, _ in blocks)
        labels = plain_labels(blocks, known)
        seen |= set(zip([b[2] for b in blocks], labels, strict=True)) | {known}
        assert extract(page) == "\n".join(b[0] for b, good in zip(blocks, labels, strict=True) if good), page
    assert len(seen) >= 4


def test_articles_of_any_language_stay():
    for text in (ITALIAN, RUSSIAN, JAPANESE):
        page = f"<body><ul><li><a href=/>home</a></li></ul><div><p>{text}</p><p>{text}!</p></div><div id=footer>{text}</div></body>"
        assert extract(page) == f"{text}\n{text}!"
    assert extract("<p>xxxxxxxxxx</p>") == "xxxxxxxxxx"
    code = "for i in range(10): total += values[i] * weights[i]  # next\n" * 7
    assert extract(f"<p>{ENGLISH}</p><pre>{code}</pre>") == f"{ENGLISH}\n{' '.join(code.split())}"


def test_adverts_inside_a_block_go():
    assert extract(f"<p>{ENGLISH} <span class='ad'>BUY NOW <b>CHEAP</b></span> {ENGLISH}</p>") == f"{ENGLISH} {ENGLISH}"
    assert extract(f"<article><p>{ENGLISH}</p><p><span class='ad'>{ENGLISH}</span></p></article>") == ENGLISH


def test_pages_that_would_hang():
    t0 = time.time()
    name = "-".join(["post"] * 40) + "x"
    assert extract(f"<div class='{name}'><p>{ENGLISH}</p></div>") == ENGLISH
    for page in ("<div " * 100_000, "<a '\"" * 50_000 + ">", "<a \">" * 50_001, "<!--" * 100_000, "<b x>" * 50_000 + "</i>" * 50_000,
                 "<script>" * 20_000, "< " * 200_000, "&" * 200_000, "<p>" * 100_000 + "</div>" * 100_000, "a" * 2_000_000):
        extract(page)
    assert time.time() - t0 < 30


def test_empty_table_and_null_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "page_id long, html string")
    assert [r.text for r in ht.main_text(pages).collect()] == ["", "", ""]
    assert ht.main_text(pages.limit(0)).count() == 0
