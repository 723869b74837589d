"""Main text of pages: planted articles, odd markup."""

import math
import re
import time
from html import unescape

import pytest

from normtrace.llm import html_density, queries


def planted(html):
    article = html[html.index("<article>") + 9:html.index("</article>")]
    parts = [" ".join(unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(p for p in parts if p)


def test_query_gives_planted_articles(spark):
    pages = {r.page_id: r for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()}
    got = queries.op5_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == planted(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PARAGRAPH = "Some words of the story follow here, one after the other, until it ends. " * 5
CASES = {
    "": "",
    "plain text": "plain text",
    "<p>a<p>b": "a\n\nb",
    "a < b and c > d": "a < b and c > d",
    "<p>a &amp; b&nbsp;c &lt;x&gt; &copy2 &unknown;": "a & b c <x> ©2 &unknown;",
    "<!-- x -->t<!-- open": "t",
    "<script>var a = '<p>';</script>hello<style>p{}</style>": "hello",
    "<p>1<br>2</p>\n<p> 3\t4 </p>": "1 2\n\n3 4",
    "<div></span></p></div>": "",
    f"<body><header>Site</header><nav><a href=/>Home</a></nav><div id=content><h1>T</h1><p>{PARAGRAPH}</p><ul><li>x<li>y</ul></div>"
    f"<div class='left-sidebar'><p>{PARAGRAPH}</p></div><div class=comments><p>{PARAGRAPH}</p></div><form><p>mail</form><footer>z</footer>":
        f"T\n\n{PARAGRAPH.strip()}\n\nx\n\ny",
    f"<main><article><header><h1>H</h1></header><p>{PARAGRAPH}</p><div class=ad>buy</div><p>End.</p><footer>by</footer></article></main><div>More</div>":
        f"H\n\n{PARAGRAPH.strip()}\n\nEnd.",
    f"<body><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div><a href=1>one link</a> <a href=2>two links</a> <a href=3>three links</a></div>":
        f"{PARAGRAPH.strip()}\n\n{PARAGRAPH.strip()}",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert html_density.main_text(html) == CASES[html]


def test_deep_and_long_pages():
    assert html_density.main_text("<div>" * 5000 + "<p>deep</p>") == "deep"
    assert html_density.main_text("<p>word</p>" * 20_000).count("word") == 20_000


def test_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x</p>", "t"), (2, "v", "", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_density.extract_pages(frame).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1), (2, "v", "", 0)], key=str)
    assert html_density.extract_pages(frame.limit(0)).count() == 0


@pytest.mark.parametrize("html, parts", [
    (f"<body><div><p>{PARAGRAPH}</p></div><div><p>{PARAGRAPH}</p></div>", 2),
    (f"<body><article><p>{PARAGRAPH}</p></article><article><p>{PARAGRAPH}</p></article>", 2),
    (f"<body><main><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><article><p>{PARAGRAPH}</p></article></main>", 3),
    (f"<body><article><p>{PARAGRAPH}</p><article><p>{PARAGRAPH}</p></article></article>", 2),
])
def test_no_two_and_nested_articles(html, parts):
    assert html_density.main_text(html) == "\n\n".join([PARAGRAPH.strip()] * parts)


@pytest.mark.parametrize("html, title", [
    (f"<body><div class='content with-sidebar'><p>{PARAGRAPH}</p></div>", ""),
    (f"<body><div id='page' class='no-ads'><p>{PARAGRAPH}</p></div>", ""),
    (f"<body><div><div class='entry-header'><h1>Title</h1></div><p>{PARAGRAPH}</p></div>", "Title\n\n"),
    (f"<body><div class='search-results'><p>{PARAGRAPH}</p></div>", ""),
    (f"<body><div class=sidebar><p>{PARAGRAPH}</p></div><div class=nav><a href=1>{PARAGRAPH}</a></div>", ""),
    (f"<body><div><p>{PARAGRAPH}</p></div><div class=comments><p>{PARAGRAPH * 5}</p></div>", ""),
    (f"<body><div class=comments><p>{PARAGRAPH}</p></div>", ""),
])
def test_names_of_content(html, title):
    assert html_density.main_text(html) == title + PARAGRAPH.strip()


@pytest.mark.parametrize("html", [
    f"<body><div><p title='a hidden gem'>{PARAGRAPH}</p></div>",
    f"<body><div><p title='the hidden house' data-note='class=menu'>{PARAGRAPH}</p></div>",
    f"<body><div><p data-x=it's>{PARAGRAPH}</p></div>",
    f"<body><div><p>{PARAGRAPH.replace('the story', '<a href=page?id=menu>the story</a>')}</p></div>",
    f"<body><form action=/ method=post><nav>Home</nav><div><p>{PARAGRAPH}</p></div><input name=state></form>",
    f"<body><div class='a\" b'><p title=\"never closed>{PARAGRAPH}</p></div>",
    f"<body><div><p>{PARAGRAPH}</p></div><form><p>mail <input></form>",
])
def test_attributes_quotes_and_forms(html):
    assert html_density.main_text(html) == PARAGRAPH.strip()


@pytest.mark.parametrize("piece", ["<a b ", '<a b="', "<a b='>", "</p", "<p ' \" ", "<!-", "<div></b></i>", "<p><table></p>", "</ul><li>", "<body>x", "<script>", "<title>x", "< "])
def test_broken_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    html_density.parse(page)
    assert time.process_time() - start < 8


def test_stray_ends_on_deep_pages():
    start = time.process_time()
    html_density.main_text("<p><table>" + "<div>" * 20_000 + "word" + "</p></b>" * 20_000)
    assert time.process_time() - start < 8


def plain_density(element):
    """Characters, tags, link characters and link tags of a subtree, counted by recursion."""
    counts = [0, 0, 0, 0]
    for part in element.parts:
        if isinstance(part, str):
            counts[0] += sum(not c.isspace() for c in unescape(part))
        else:
            below = plain_density(part)
            counts = [a + b for a, b in zip(counts, below)]
            counts[1] += 1
            counts[3] += part.tag == "a"
    if element.tag == "a":
        counts[2] = counts[0]
    return counts


def test_densities_equal_a_plain_count(spark):
    for page in queries.table(spark, "/root/testdata/sf0.001", "pages").collect():
        root = html_density.parse(page.html)
        order = html_density.weigh(root)
        _, _, links, _ = plain_density(root)
        share = links / max(1, root.chars)
        want = {}
        for e in order:
            chars, tags, link_chars, link_tags = plain_density(e)
            weight = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
            base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
            want[id(e)] = chars / max(1, tags) * math.log(weight) / base if chars and weight > 1 else 0.0
        for e in order:
            assert e.density == pytest.approx(want[id(e)])
            assert e.total == pytest.approx(sum(want[id(c)] for c in e.children()))
