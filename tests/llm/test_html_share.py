"""Templates of big hosts and of pages without an article."""

import time

import pytest

from faultspark.llm import html_template


def test_section_templates_and_bare_lists(spark):
    menu = "<ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul><p>All rights reserved</p>"
    rows = [(i, f"http://big.org/{i}", f"<body>{menu if i < 25 else ''}<p>Text <b>of</b> {i}</p></body>") for i in range(100)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r.page_id: r.text for r in html_template.extract(table).collect()}
    assert out == {i: f"Text of {i}" for i in range(100)}


def text(page):
    return html_template.Page(page).text(lambda d: False)


def test_class_words_do_not_remove_the_article():
    for name in ("page has-sidebar", "sidebar", "header-content", "banner"):
        assert text(f'<div class="{name}"><article><p>Words</p></article></div>') == "Words"
    for name in ("entry-header", "notice-board", "related-work", "share-holders", "searching"):
        assert text(f'<article><div class="{name}"><h1>T</h1></div><p>x</article>') == "T\nx"
    for name in ("share-buttons", "left-sidebar", "mainNav", "ad", "related-posts", "comments-list", "cookie_notice box"):
        assert text(f'<article><p>x<div class="{name}">gone</div></article>') == "x"
        assert text(f'<p>x<div class="{name}">gone</div>') == "x"
    assert text('<form><article><p>x</article></form>') == text('<p>x<form><p>gone</form>') == "x"
    assert text('<article><p>x</article><div id=comments><article class=comment>gone</article></div><article class="comment">gone</article>') == "x"
    assert text('<div class=sidebar><article>teaser</article></div><article>x</article>') == "x"


def test_character_references():
    assert text("<p>&#65;&#x41;&#00065;&amp;&eacute;&copy") == "AAA&é©"
    assert text("<p>a&#" + "9" * 6000 + ";b&#" + "0" * 6000 + "66;&#;&#x;") == "a\ufffdbB&#;&#x;"


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<a '\"", "<!x ", "<!-- ", "<i><h1>", "<div>", "</p>", "<b></i>", "<main></main>", "<script", "&#1", "<p><td><i><h1>", "<a><article>", "&lt;", "</script ", "<title><"])
def test_broken_markup_takes_linear_time(unit):
    page = "<p>start</p>" + unit * (1_000_000 // len(unit))
    began = time.process_time()
    html_template.Page(page).text(lambda d: False)
    assert time.process_time() - began < 20


def test_deep_nesting_loses_no_text():
    assert text("<div><article>" + "<div>" * 900 + "in" + "</div>" * 900 + "<p>out</article></div><p>not") == "in\nout"
