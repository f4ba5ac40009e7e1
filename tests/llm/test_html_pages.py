"""Pages of which the article, and all of it, is the text."""

from __future__ import annotations

import pytest

from proselens.llm import html_text


@pytest.mark.parametrize(
    "page",
    [
        '<body><article><header class="entry-header"><h1>Title</h1></header><p>Body of it.</p></article></body>',
        '<body><article><header class="header"><h1>Title</h1></header><p>Body of it.</p></article></body>',
        '<body><div class="site has-sidebar"><article><h1>Title</h1><p>Body of it.</p></article></div></body>',
        '<body><div class="sidebar"><article><h1>Title</h1><p>Body of it.</p></article></div><p>Else</p></body>',
        '<body><form><main><h1>Title</h1><p class="text_widget">Body of it.</p></main></form></body>',
        '<body><main><h1>Title</h1><p>Body of it.</p><div class="ad">Buy</div></main><div class="sidebar"><article>More</article></div></body>',
    ],
)
def test_html_keeps_the_article(page):
    assert html_text.Page(page).text() == "Title\nBody of it."


def test_html_copies_of_an_article_are_no_wrapper(spark):
    copy = "<body><article><h1>One</h1><blockquote>Said once.</blockquote><p>And more.</p></article></body>"
    other = "<body><article><h1>Item %d</h1><p>Text %d</p></article></body>"
    pages = [(i, "http://h.org/", copy if i < 3 else other % (i, i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "One\nSaid once.\nAnd more." if i < 3 else f"Item {i}\nText {i}" for i in range(6)}
