import html as references
import random
import re
import time

import numpy as np
import pytest

from craquelure.llm import boosting, html, queries


def article(source):
    """The text of the article element of these well-formed enough pages."""
    inner = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    if inner is None:
        return ""
    spaced = re.sub(r"</?(p|h1|h2|ul|li|div|blockquote)( [^>]*)?>|<br>", " ", inner[1])
    return " ".join(references.unescape(re.sub(r"<[^>]+>", "", spaced)).split())


def test_query_finds_the_articles(spark, folder):
    sources = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.op2_html(spark, folder).collect()
    assert len(rows) == len(sources)
    assert all(r.n_chars == len(r.text) for r in rows)
    same = [r.text == article(sources[r.page_id]) for r in rows]
    assert sum(same) >= 0.99 * len(same)


@pytest.fixture(scope="module")
def sources(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    return [r.html for r in rows]


@pytest.fixture(scope="module")
def trees(sources):
    return html.learn(sources[:100])


def test_held_out_layouts(sources, trees):
    r = random.Random(77)
    right = total = 0
    for s in sources[100:]:
        page = html.parse(html.layout(*html._parts(html.parse(s)), r))
        kept = html.decode(page, trees.logit(html.features(page)))
        for owner, text in zip(page.owner, page.text):
            total += len(text)
            right += len(text) * (kept[owner] == (page.label[owner] == 1))
    assert right / total > 0.95


def test_parser():
    page = html.parse(
        "<title>no</title><p>a <b>b&amp;c</b>d<p>e<br>f<!-- x > y --><ul><li>g<li>h</ul><script>if (a<b) '</p>'</script>"
        "<DIV CLASS=\"sideBar\">i&nbsp; j</div> k < l <table><tr><td>m<td>n</table>"
    )
    assert page.text == ["a b&cd", "e f", "g", "h", "i j", "k < l", "m", "n"]
    assert page.signs[page.owner[4]] == 1 << 4
    assert html.parse("<div>" * 3000 + "deep").text == ["deep"]
    assert html.parse("<p>cut off <b").text and html.parse("<script>never ends").text == []


@pytest.mark.parametrize(
    "source, text",
    [
        ('<p class="a"">Hello world text</p>', ["Hello world text"]),
        ("<article><p title=it's>Hello world</p><p>don't</p></article>", ["Hello world", "don't"]),
        ("<!--> <p>y</p> -->", ["y", "-->"]),
        ("<!---><p>y</p><!-- a --!><p>z</p><!-- never closed <p>x", ["y", "z"]),
        ('<p a="x" b = \'>\' c="</p>" d>kept</p>', ["kept"]),
        ('<p title="never closed>one</p><p>two</p>', ["one", "two"]),
        ("<p>one</></ x>two</p/ y>three<?php x ?><!DOCTYPE html>", ["onetwo", "three"]),
        ("<script>a</scripts>b</script x><p>c", ["c"]),
        ("<p>1 < 2, a <3 b</p><p>cut off <b", ["1 < 2, a <3 b", "cut off"]),
        ("<p =x>a</p><p/x/y=z/>b", ["a", "b"]),
        ("<p data-y=abc>a</p><p data-y>b", ["a", "b"]),
    ],
)
def test_malformed_tags(source, text):
    assert html.parse(source).text == text


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 100_000 + "deep",
        "<div>" * 50_000 + "</em></section>" * 50_000 + "deep",
        "<a b=\"" * 50_000 + "'" + "<p 'x" * 50_000 + ">deep",
        "<p x=\"y'>" * 99_999 + "deep",
        "<p " * 100_000 + ">deep",
        "<svg><noscript>" * 50_000 + "deep",
        "<! <? </ <!-" * 30_000 + ">deep",
        "<!-->" * 100_000 + "deep",
        "< a" * 100_000 + "deep",
        "<p" + " " * 100_000 + "x" + "\t" * 100_000 + "=" * 100_000 + ">deep",
    ],
)
def test_hostile_pages_take_linear_time(source):
    start = time.process_time()
    page = html.parse(source)
    assert time.process_time() - start < 2
    assert page.text[-1].endswith("deep") or source.startswith("<a b")


def test_decoding_is_consistent():
    page = html.parse("<div><p>x</p><div><p>y</p></div></div>")
    # nodes: body, div, p, div, p
    kept = html.decode(page, html.np.array([0.0, -1, 3, -5, 4]))
    assert kept.tolist() == [True, True, True, False, False]
    assert html.decode(page, html.np.array([0.0, -9, 3, -5, 4])).tolist() == [True, False, False, False, False]


def test_boosting_learns_a_rule():
    r = html.np.random.default_rng(1)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = boosting.fit(x, y)
    assert ((t.logit(x) > 0) == (y == 1)).mean() > 0.97


def test_odd_rows(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain words only"), (3, "u", "<p>" * 2000), (3, "u", "<p>" * 2000)]
    rows += [(4, "u", "<html><body></body></html>"), (5, "u", "&lt;not a tag&gt; &#x41;")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages, trees).collect()
    assert len(got) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in got}
    assert texts[1, "u"] == texts[2, None] == texts[3, "u"] == texts[4, "u"] == ""
    assert texts[None, "u"] == "plain words only" and texts[5, "u"] == "<not a tag> A"
    assert html.extract(pages.limit(0), trees).count() == 0
    html.fit(pages.limit(0))


@pytest.mark.parametrize("n", [500, 1500])
def test_a_rare_sibling_stands_out_among_any_number(n):
    page = html.parse("<p>words of a paragraph</p>" * n + "<div>an advert</div>")
    rare = html.features(page)[page.tag.index("div")]
    assert np.isclose(rare, 1 / (n + 1), rtol=1e-6, atol=0).any()
