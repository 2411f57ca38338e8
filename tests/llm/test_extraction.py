"""Extraction against a plain reading of the tables' own pages, and against pages whose article is known."""

import html
import re
import time

import pytest
from tidemark.llm import extraction, queries

ARTICLE = "<h1>Title</h1><p>First, with &lt;marks&gt; &amp; more words, of some length.</p><p>Second <b>bold</b>&nbsp;one,\n  over\tlines.</p><ul><li>a point<li>another</ul>"
TEXT = ["Title", "First, with <marks> & more words, of some length.", "Second bold one, over lines.", "a point", "another"]
PROSE = "<p>" + "Words, and words, that read like prose, on and on, " * 9 + "</p>"
AROUND = {
    "nav": f"<nav>{PROSE}</nav>", "role": f'<div role="navigation">{PROSE}</div>', "header": f"<header>{PROSE}</header>", "footer": f"<footer>{PROSE}</footer>", "aside": f"<aside>{PROSE}</aside>",
    "sidebar": f'<div class="left-sidebar">{PROSE}</div>', "notice": f'<div id="cookie_notice">{PROSE}</div>', "ad": f'<div class="ad">{PROSE}</div>', "form": f"<form>{PROSE}<input></form>",
    "script": "<script>var t = '</p><p>text';</script>", "style": "<style>p{}</style>", "comment": "<!-- <p>not text</p> -->", "readers": f'<section id="comments"><article class="comment">{PROSE}{PROSE}</article></section>',
    "hidden": f'<div hidden>{PROSE}</div><div style="display: none">{PROSE}</div>', "template": f"<template>{PROSE}</template>", "list of links": "<ul>" + '<li><a href="/x">a link of some words</a>' * 9 + "</ul>",
}


@pytest.mark.parametrize("name", AROUND)
@pytest.mark.parametrize("shape", ["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<article class="with-comments"><div>%s</div></article>', '<form id="aspnet"><article>%s</article></form>'])
def test_what_surrounds_an_article_goes(name, shape):
    other = AROUND[name]
    body = PROSE + ARTICLE + PROSE
    want = [" ".join(re.sub("<[^>]*>", "", PROSE).split()), *TEXT, " ".join(re.sub("<[^>]*>", "", PROSE).split())]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'>{other}<div>{shape % body}</div>{other}</body></html>"
    assert extraction.main_text(page) == want
    inside = f"<html><body>{shape % (body + other)}"
    assert extraction.main_text(inside) == want


def test_broken_markup():
    read = extraction.main_text
    assert read("<p><b>one<br><p>two</b> three</i><p>four") == ["one", "two three", "four"]
    assert read("<article><p>a<table><tr><td>b<td>c<tr><td>d</table>e") == ["a", "b", "c", "d", "e"]
    assert read('<article><p title="a > b" class=x"y>text</p><p>cut <a href="') == ["text", "cut"]
    assert read("<article><p>5 < 6 && 7 > 3 &copy &#x41; &bogus;</article>") == ["5 < 6 && 7 > 3 © A &bogus;"]
    assert read("<ARTICLE><P>Upper</P></ARTICLE><SCRIPT>x</p></SCRIPT >") == ["Upper"]
    assert read("only words") == ["only words"]
    assert read(None) == read("") == read("<nav>menu</nav>") == read("<script>open") == read("<!-- open") == []


def test_siblings_and_sections():
    sections = "".join(f"<section><h2>{k}</h2><p>Part {k}, with words, and words.</p></section>" for k in range(6))
    want = [x for k in range(6) for x in (str(k), f"Part {k}, with words, and words.")]
    assert extraction.main_text(f"<body><div>{sections}</div><footer>f</footer>") == want
    page = f"<body><div id=top><a href=/>home</a> <a href=/b>b</a> <a href=/c>c</a></div><div><h1>T</h1><div>{PROSE}</div><div>{PROSE}</div></div>"
    assert len(extraction.main_text(page)) == 3


@pytest.mark.parametrize("page", ["<" * 200000, "<p>x" * 30000, "<div>x" * 30000, '<a b="' * 50000, "<!--" * 50000, "<p></b>" * 30000, "<ul><li>" * 20000, "&amp" * 100000, "</p" * 50000])
def test_long_hostile_pages_take_linear_time(page):
    began = time.process_time()
    extraction.main_text(page)
    assert time.process_time() - began < 20


def plain(page):
    """The article of the tables' pages, by their own fixed shape."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_query_over_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r["page_id"]: (r["url"], plain(r["html"]), len(plain(r["html"]))) for r in pages.collect()}
    assert {r[0]: tuple(r[1:4]) for r in queries.op13_extraction(spark, "/root/testdata/sf0.001").collect()} == want


def test_odd_rows(spark):
    rows = [(1, None, None, "t"), (None, "u", "", None), (2, "u", f"<article>{ARTICLE}</article>", "t"), (2, "u", f"<article>{ARTICLE}</article>", "t"), (3, "u", "<p>" + "long, " * 200000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    clash = pages.selectExpr("*", "1 as n_blocks", "'h' as _html")
    got = [tuple(r) for r in extraction.extract(clash).select("page_id", "url", "html", "_html", "text", "n_blocks").collect()]
    assert [(r[0], r[1], r[3], r[5]) for r in got] == [(1, None, "h", 0), (None, "u", "h", 0), (2, "u", "h", 5), (2, "u", "h", 5), (3, "u", "h", 1)]
    assert [r[4] for r in got] == ["", "", "\n".join(TEXT), "\n".join(TEXT), " ".join(["long,"] * 200000)]
    assert extraction.extract(pages.limit(0)).collect() == []
