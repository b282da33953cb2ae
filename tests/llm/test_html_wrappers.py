import pytest
from roadlines.llm.html_text import extract, outer_name

LONG = "It was the best of times and it was the worst of times, for all of them that had been there with us."


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-sidebar", "elementor-widget-container", "widget"])
def test_wrapper_of_an_article_is_no_boilerplate(name):
    assert extract(f"<body><div class='{name}'><article><p>{LONG}</p></article></div></body>") == LONG
    if name != "widget":
        assert extract(f"<body><div class='{name}'><p>{LONG}</p></div></body>") == LONG


def test_outer_names_still_count():
    for name in ["ad", "cookie-notice", "site-header", "main nav", "sidebar-1", "comments-area", "comment_list", "ad-300x250"]:
        assert outer_name(name), name
    inner = f"<ol id='comments'><li><article class='comment-body'><p>{LONG}x</p></article></ol>"
    assert extract(f"<article><p>{LONG}</p></article>{inner}") == LONG
    assert extract(f"<main><p>{LONG}</p><section class='related'><article><p>{LONG}x</p></article></section></main>") == LONG
    assert extract(f"<p>{LONG}</p><aside><article><p>{LONG}x</p></article></aside>") == LONG
