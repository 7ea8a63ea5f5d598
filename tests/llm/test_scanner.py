"""Pages whose markup is broken take time in proportion to their length."""

import time

import pytest

from tallyforge.llm import htmltext

N = 100_000
BROKEN = {
    "open tag": "<p>hi</p> <a " + "x" * 10**6,
    "open tag before an apostrophe": "<p>a <b " + "y" * 10**6 + " it's fine</p>",
    "many open tags": "<a " * 300_000,
    "open quotes": "<a '" * 250_001 + ">",
    "declarations": "<!x" * 300_000,
    "inline elements below blocks": "<b>" * N + "<h1>x" * N,
    "ends of what isn't open": "<div>" * N + "x</i>" * N,
    "a scope between": "<p><div>" + "<b>" * N + "<h1>x" * N,
    "comments": "<!--" * N,
    "scripts": "<script>" * N,
    "null characters": "\0" * 10**6,
    "list items": "<ul>" * N + "<li>x" * N,
}


@pytest.mark.parametrize("name", BROKEN)
def test_time_follows_the_page(name):
    began = time.time()
    htmltext.split_page(BROKEN[name])
    assert time.time() - began < 10


def test_cut_off_anywhere():
    page = "<html><body><nav><a href='/x' title=\"a > b\">menu</a></nav><!-- c --><article class='x'><h1>Head &amp; tail</h1><p>One <b>two</b><br>three</p></article></body></html>"
    whole = [t for *_, t in htmltext.blocks(page)]
    assert whole == ["menu", "Head & tail", "One two three"]
    for k in range(len(page)):
        htmltext.blocks(page[:k])


def test_what_is_no_tag_is_text():
    texts = lambda page: [t for *_, t in htmltext.blocks(page)]
    assert texts("<p>1 < 2 and a <b it's") == ["1 < 2 and a <b it's"]
    assert texts("<p>x <a 'y</p><p>z' > w</p>") == ["x w"]
    assert texts("a <! b") == ["a <! b"]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<article><p>" + "word " * 300_000), (4, "u", "<article>x\0y <b"), (4, "u", "<article>x\0y <b")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id, len(r.text)) for r in htmltext.extract(pages).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 4] and got[0][1] == got[1][1] == 0 and got[2][1] == 1_499_999
