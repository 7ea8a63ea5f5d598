"""Main text of web pages: the suffix array, what it decides, and what markup decides."""

import html
import random
import re

import numpy as np
import pytest

from tallyforge.llm import htmltext

SF = "/root/testdata/sf0.001"


def test_html_of_the_tables(spark):
    frame = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract(frame).collect()}
    for r in frame.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        own = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d)>", inner))
        text = "\n".join(x for x in own if x)
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


def test_html_by_host(spark):
    menu, legal = "<div>Home and news and all other sections</div>", "<div>All rights reserved by the example company since 1999</div>"
    page = lambda i: f"<html><head><title>t</title></head><body>{menu}<div>Story number {i} has&nbsp;its own\n words <b>he</b>re</div>{legal}</body></html>"
    rows = [(i, "http://h.example/" + str(i), page(i)) for i in range(5)] + [(9, "http://other.example/", page(9))]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("rights" not in got[i] and "Home" not in got[i] and str(i) in got[i] for i in range(5))
    assert got[9].split("\n") == ["Home and news and all other sections", "Story number 9 has its own words here", "All rights reserved by the example company since 1999"]


def test_html_by_host_keeps_what_is_not_boilerplate(spark):
    menu = "<div>Home and news and all other sections</div>"
    quote = "a quoted passage " + " ".join(f"q{i}" for i in range(50))
    rows = [(i, f"http://copies.example/{i}", f"<body>{menu}<div>One story on three addresses of this host</div></body>") for i in range(3)]
    for i in range(40):  # a large host: a passage on three pages, a phrase on twelve, a menu on all
        own = f"<div>Story {i} of its own {'as we all know from the news' if i < 12 else 'without it'} ends here {i}</div>"
        rows.append((100 + i, f"http://large.example/{i}", f"<body>{menu}{own}{f'<p>{quote}</p>' if i < 3 else ''}</body>"))
    # Two pages whose open and dropped blocks say the same.
    same = "<div>All of this is said two times over</div>"
    rows += [(200 + i, f"http://twice.example/{i}", f"<body>{same}<p>Story number {i}</p><nav>{same}</nav></body>") for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text.split("\n") for r in htmltext.extract(frame).collect()}
    assert all(got[i] == ["Home and news and all other sections", "One story on three addresses of this host"] for i in range(3))
    for i in range(40):
        assert got[100 + i] == [f"Story {i} of its own {'as we all know from the news' if i < 12 else 'without it'} ends here {i}", *[quote] * (i < 3)]
    assert all(got[200 + i] == ["All of this is said two times over", f"Story number {i}"] for i in range(2))


def own(page):
    marked, texts, main = htmltext.split_page(page)
    return marked, [t for t, m in zip(texts, main, strict=True) if m]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><header><h1>T</h1></header><p>a<br>b<div class='ad'>zz</div>c<section id=comments><article>cc</article></section><form>f</form><p>end &lt;x&gt; &amp;amp;</article><p>out", ["T", "a b", "c", "end <x> &amp;"]),
        ("<main><p>Hello <b>wor</b>ld<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><aside>x</aside></main><p>z", ["Hello world", "a", "b", "c", "d"]),
        ("<article><p>one<script>var t='</p>';</script> two<!-- <p>no --><style>p{}</style></article>", ["one two"]),
        ("<article><p hidden>h<p style='display: none'>i<p role=alert>j<p>k<noscript>n</noscript></article>", ["k"]),
        # Wrappers are no reason to drop the only article, nor are parts of a class name.
        ('<div class="content has-sidebar"><article><p>Body text here</article></div>', ["Body text here"]),
        ('<div class="sidebar"><article><p>Body text here</article></div>', ["Body text here"]),
        ('<form id="aspnetForm"><nav>n</nav><article><p>Body text here</article></form>', ["Body text here"]),
        ("<form><main><p>a<form><p>b</form></main></form>", ["a"]),
        ('<article><div class="related-work">a</div><section id="notice-of-risk">b</section><div class="share-price">c</div><p>d <math><mi>x</mi></math> e</article>', ["a", "b", "c", "d x e"]),
        ('<article><p>a</p><div class="cookie-banner">b</div><div class="share-buttons big">c</div><p>d</article>', ["a", "d"]),
        ('<article><p>a</article><div class="related"><article><p>teaser</article></div><aside><article>b</article></aside>', ["a"]),
        ('<article><p>a<div class="comments"><article class="reply"><p>I agree</article></div></article>', ["a"]),
    ],
)
def test_marked_pages(page, want):
    assert own(page) == (True, want)


def test_unmarked_pages():
    assert own("<p>only") == (False, ["only"])
    assert own("<nav>n</nav><p>text of the page</p><form><p>Name</p></form>") == (False, ["text of the page"])
    assert own("<p>x</p><form id=aspnetForm><p>text of the whole page</p><button>b</button></form>") == (False, ["x", "text of the whole page"])
    assert own("") == (False, []) == own("<nav>n</nav>")


def test_suffix_array():
    r = random.Random(6)
    for n in (0, 1, 2, 7, 60, 300):
        for letters in (1, 2, 5):
            ids = [r.randrange(letters) for _ in range(n)]
            order, levels = htmltext.suffix_array(np.array(ids, np.int64))
            assert order.tolist() == sorted(range(n), key=lambda i: ids[i:])
            got = htmltext.common_prefixes(order, levels).tolist()
            for k in range(1, n):
                a, b = ids[order[k - 1] :], ids[order[k] :]
                assert got[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_repeats():
    """Covered tokens against a count of every substring."""
    r = random.Random(7)
    for depth, letters in ((3, 3), (4, 2), (6, 2)):
        streams = [[r.randrange(letters) for _ in range(r.randint(0, 25))] for _ in range(14)]
        streams.append(streams[3] + streams[5])
        owners = [r.randrange(9) for _ in streams]
        holds: dict = {}
        for s, o in zip(streams, owners, strict=True):
            for i in range(len(s)):
                for j in range(i + depth, len(s) + 1):
                    holds.setdefault(tuple(s[i:j]), set()).add(o)
        for least in (2, 4):
            want = []
            for s in streams:
                gone = [False] * len(s)
                for i in range(len(s)):
                    for j in range(i + depth, len(s) + 1):
                        if len(holds[tuple(s[i:j])]) >= least:
                            gone[i:j] = [True] * (j - i)
                want += gone
            got = htmltext.Runs([np.array(s, np.int64) for s in streams], depth).covered(np.array(owners), least)
            assert got.tolist() == want


def test_sections():
    rows = [("a", i, 10, 0) for i in range(25)] + [("a", 0, 10, 1)] + [("b", 0, 500, 0), ("b", 1, 10, 0)]
    got = list(htmltext._sections(rows, 50))
    assert [r for s in got for r in s] == rows and all(len({(r[0], r[3]) for r in s}) == 1 for s in got)
    assert [len(s) for s in got[:4]] == [5, 5, 5, 10 if len(got[3]) == 10 else 5]
    assert all(sum(r[2] for r in s) >= 50 for s in got if s[0][0] == "a" and s[0][3] == 0)


def test_the_array_decides_inside_of_articles(spark):
    """A notice without any mark, in most articles of a host, goes; a passage in a few stays, and so do copies."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    notice, quote = "Read our terms before you share this story with your friends", say(60)
    rows, want = [], {}
    for i in range(30):
        blocks = [say(40), say(30), *[quote] * (i < 6)]
        rows.append((i, f"https://a.example/{i}", f"<article><p>{blocks[0]}</p><p>{notice}</p>{''.join(f'<p>{b}</p>' for b in blocks[1:])}</article>"))
        want[i] = blocks
    text = [say(50), say(20), say(30)]
    for i in range(12):  # copies, exact and with one word changed
        last = text[2] + (f" {i}" if i > 6 else "")
        rows.append((100 + i, f"https://b.example/{i}", f"<article>{''.join(f'<p>{b}</p>' for b in [*text[:2], last])}</article>"))
        want[100 + i] = [*text[:2], last]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {x._id: x for x in htmltext.decisions(frame).collect()}
    assert {i: x.text.split("\n") for i, x in got.items()} == want
    assert {i for i, x in got.items() if x.by_array} == set(range(30))


def test_pages_of_a_third_without_article(spark):
    """The menu known from the host's other pages goes from those that mark nothing."""
    menu = "<div>Home News Sports Weather Money and our shop</div>"
    rows = [(i, f"https://a.example/{i}", f"{menu}{'<article>' if i % 3 else ''}<p>Story {i} is about number {i} and nothing else</p>{'</article>' if i % 3 else ''}") for i in range(30)]
    got = {x._id: x for x in htmltext.decisions(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(x.text == f"Story {i} is about number {i} and nothing else" for i, x in got.items())
    assert {i for i, x in got.items() if x.by_array} == {i for i in got if i % 3 == 0}
