"""Op 5. Main text of web pages by two passes of block rules.

Pass one labels each block by stop-word density, length and link density, and by the containers
it stands in. Pass two gives each block that is still open the label of its nearest decided
neighbours. The good blocks, in page order, are the text.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages that pages are written in.
STOP_WORDS = frozenset("""
the of and to a in is it that was for on are with as he be at by had this not but from have or an
they which one you were her all she there would their we him been has when who will more no if out
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus
el los se del las por con para como más pero sus lo y una su al era no entre cuando muy sin sobre
""".split())
BLOCK_TAGS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option
p pre section select summary table tbody td tfoot th thead title tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text.
DROPPED_TAGS = frozenset("""
script style noscript template svg math head title iframe object canvas audio video textarea select button
""".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template".split())
OUTER_TAGS = frozenset("nav footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
#: Parts of a class, id or role that name a part around the text, and the starts of further ones.
OUTER_PARTS = frozenset("""
ad ads adbox banner breadcrumb breadcrumbs consent cookie cookies disqus footer gdpr header login masthead menu nav navbar
navigation newsletter notice pagination popup related replies respond search share sharing sidebar side signup social
subscribe tags toolbar widget widgets
""".split())
OUTER_STARTS = ("advert", "comment", "promo", "sponsor")
#: Parts that only say where or in what form such a part stands.
PLACE_PARTS = frozenset("""
site page post posts entry top bottom left right primary secondary main global mobile area bar block body box button buttons
container form icon icons inner item items link links list article articles section slot text title trail unit wrap wrapper
""".split())
SIZE_PART = re.compile(r"\d+(?:x\d+)?")
PART = re.compile(r"[^_-]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                   r"|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
OPEN_COMMENT = re.compile(r"<!--.*", re.S)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
LINKS_MOST = 0.5


def outer_name(names: str) -> bool:
    """Some whole class, id or role consists of such names and places only: not has-sidebar or x-widget-container."""
    for name in names.lower().split():
        outer = False
        for part in PART.findall(name):
            if part in OUTER_PARTS or (part.startswith(OUTER_STARTS) and part.isalnum()):
                outer = True
            elif not (part in PLACE_PARTS or SIZE_PART.fullmatch(part)):
                break
        else:
            if outer:
                return True
    return False


def blocks_of(page: str) -> list[tuple[str, float, bool, bool]]:
    """(text, link density, in main container, in outer container) of each block with text.

    Each run of text has the containers it stands in itself. A block that also has text of its own
    loses the runs in outer inline elements, like an advert within a paragraph.
    """
    out: list[tuple[str, float, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, main, outer by tag, outer by name, dropped
    opened: Counter[str] = Counter()  # tags on the stack
    links, at, n = 0, 0, len(page)
    runs: list[tuple[str, bool, bool, bool]] = []  # text, linked, main, outer
    last_end = page.rfind(">")

    def state() -> tuple[bool, bool, bool, bool]:
        return stack[-1][1:] if stack else (False, False, False, False)

    def text(raw: str) -> None:
        main, outer, named, dropped = state()
        if raw and not dropped:
            runs.append((references.unescape(raw) if "&" in raw else raw, bool(links), main, outer or named))

    def close_block() -> None:
        if runs:
            inner = [r for r in runs if not r[3] and not r[0].isspace()]
            kept = [r for r in runs if not r[3]] if inner else runs
            joined = SPACE.sub(" ", "".join(r[0] for r in kept)).strip()
            if joined:
                linked = sum(len(SPACE.sub("", r[0])) for r in kept if r[1])
                out.append((joined, linked / len(joined.replace(" ", "")), any(r[2] for r in kept), not inner))
            runs.clear()

    while at < n:
        # without a further end of a tag only a comment can still hide anything
        m = TOKEN.search(page, at) if at <= last_end else OPEN_COMMENT.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if m.re is TOKEN else ""
        if not tag:
            continue
        closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK_TAGS:
            close_block()
        if tag == "a":
            links = 0 if closing else 1
            continue
        if closing:
            while opened[tag]:
                gone = stack.pop()[0]
                opened[gone] -= 1
                if gone == tag:
                    break
            continue
        if tag in VOID_TAGS or attrs.rstrip().endswith("/"):
            continue
        if tag in RAW_TAGS:  # nothing in it is markup, up to its own end tag
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in BLOCK_TAGS and tag not in DROPPED_TAGS and not attrs:
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            opened[stack.pop()[0]] -= 1  # its end tag may be left out
        main, outer, named, dropped = state()
        names = " ".join(x for found in NAMES.findall(attrs) for x in found if x) if attrs else ""
        outer = outer or tag in OUTER_TAGS or (tag == "header" and not main)
        by_name = bool(names and tag not in ("body", "html") and outer_name(names))
        if tag not in MAIN_TAGS:
            named = named or by_name
        elif not main:  # the name of a wrapper does not count in the page's own article, but in an article of a comment
            named = named and by_name
        dropped = dropped or tag in DROPPED_TAGS or bool(attrs and HIDDEN.search(attrs))
        stack.append((tag, main or tag in MAIN_TAGS, outer, named, dropped))
        opened[tag] += 1
    close_block()
    return out


def stop_density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def known_language(found: list[tuple[str, float, bool, bool]]) -> bool:
    """Some block of the page that is no list of links reads like one of the languages of the stop words."""
    return any(len(t) >= SHORT and links <= LINKS_MOST and stop_density(t) >= STOP_LOW for t, links, _, _ in found)


def first_pass(text: str, link_density: float, main: bool, outer: bool, known: bool = True) -> bool | None:
    """True: main text; False: boilerplate; None: open.

    Stop words count on pages in a language that they are `known` of; on others length and links
    decide alone.
    """
    if outer:
        return False
    if link_density > LINKS_MOST and not (main and link_density < 1):
        return False
    if len(text) < SHORT:
        return None
    if not known:
        return True if main or len(text) >= LONG else None
    density = stop_density(text)
    if density >= STOP_LOW and (density >= STOP_HIGH or len(text) >= LONG or main):
        return True
    return None


def second_pass(labels: list[bool | None], main: list[bool]) -> list[bool]:
    """Open blocks take the label of the nearest decided neighbours within their own container.

    Where both sides decide and differ, or none decides, a block is good if it stands in a main
    container.
    """
    n = len(labels)
    before: list[bool | None] = [None] * n
    after: list[bool | None] = [None] * n
    for seen, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last, last_main = None, None
        for i in order:
            if main[i] != last_main:
                last, last_main = None, main[i]
            if labels[i] is not None:
                last = labels[i]
            seen[i] = last
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = {x for x in (before[i], after[i]) if x is not None}
            label = near.pop() if len(near) == 1 else main[i]
        out.append(label)
    return out


def extract(page: str) -> str:
    found = blocks_of(page)
    known = known_language(found)
    main = [b[2] and not b[3] for b in found]
    labels = second_pass([first_pass(*b, known) for b in found], main)
    if not any(labels):  # no block speaks for itself: the longest that is neither links nor around the text
        longest = max((len(t) for t, links, _, outer in found if not outer and links <= LINKS_MOST), default=0)
        labels = [len(t) == longest and not outer and links <= LINKS_MOST for t, links, _, outer in found]
    return "\n".join(b[0] for b, good in zip(found, labels, strict=True) if good)


def main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of each page's whole html. Null or empty html gives an empty text.

    A closed `a` counts the characters it held as linked. White space inside a block, line breaks
    included, becomes one space. A page whose blocks all stay open keeps its longest ones that are
    not mostly links. Rows are neither dropped nor shuffled; an existing column `text` is replaced.
    """
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(x.as_py() or "") for x in batch], pa.string())

    return pages.withColumn(text, run(F.col(html)))
