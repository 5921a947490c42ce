import collections
import html
import re

import pytest
from pyspark.sql import functions as F

from partsmith.llm import html_templates as H
from partsmith.llm.page_blocks import CLOSE, Page

SCHEMA = "page_id long, url string, html string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("text", "host", "n_chars", "container", "print")})
    return {r.page_id: (r.text, r.n_chars) for r in H.extract(df).collect()}


def words(i, n):
    return " ".join(f"w{(i * 7919 + j * 104729) % 9973}" for j in range(n))


def test_occurrence_vectors_group_tokens_like_lists(spark):
    pages = [f"<html><body><div class=a><ul>{'<li>x' * (1 + i % 3)}</ul></div><p>{words(i, 5)}</p><p>same</p></body></html>" for i in range(9)]
    df = spark.createDataFrame([("h", i, Page(p).tokens, Page(p).kinds) for i, p in enumerate(pages)],
                               "host string, print long, tokens array<long>, kinds array<tinyint>")
    got = collections.defaultdict(set)
    for r in df.mapInArrow(H._vectors, H._VECTORS).groupBy("host", "token").agg(F.sum("v1").alias("a"), F.sum("v2").alias("b"), F.sum("pages").alias("n")).collect():
        got[r.a, r.b, r.n].add(r.token)
    vectors = collections.defaultdict(set)
    counts = [collections.Counter([H._EVERY_PAGE, *Page(p).tokens]) for p in pages]
    for t in set().union(*counts):
        vectors[tuple(c[t] for c in counts)].add(t)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, vectors.values()))
    assert max(map(len, vectors.values())) >= 6  # tags of the frame and the constant run


def test_order_and_nesting_of_classes():
    classes = {1: 10, 2: 10, 3: 20, 4: 20}
    nested = H.shapes([1, 3, 4, 3, 4, 2], classes)
    assert nested == H.shapes([1, 9, 3, 4, 2], classes) and 0 not in nested.values()
    assert H.shapes([3, 4, 1, 2], classes)[20] != nested[20]  # another gap
    assert H.shapes([2, 1], classes)[10] != nested[10]  # another order
    crossing = H.shapes([1, 3, 2, 4], classes)
    assert crossing[20] == 0 and crossing[10] != 0  # of two that cross the inner one goes, unless it is larger
    assert H.shapes([1, 3, 4, 2, 5], {1: 10, 2: 10, 3: 20, 4: 20, 5: 20})[10] == 0
    assert H.shapes([1, 1, 2], classes)[10] == 0  # begins again before its end


def test_tags_come_in_pairs():
    page = Page("<p>a<p>b<ul><li>c<li>d</ul></div></section>e<table><tr><td>f<td>g<tr><td>h")
    assert page.text == ["a", "b", "c", "d", "e", "f g", "h"]
    depth = 0
    for kind in page.kinds:
        depth += {CLOSE: -1, 2: 0}.get(kind, 1)
    assert depth == 0


ARTICLE = """<!DOCTYPE html><html><head><title>t{i}</title><script>var t="</p><p>not text</p>";</script><style>p{{}}</style></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/{i}">menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies {i}</div>
<aside>side {i}</aside><article><h1>Title {i}</h1><!-- note --><p>{a} &amp; <b>bold</b><i>er</i>&nbsp;&lt;x&gt; a < b</p>
<div class="ad-slot">Buy {i}</div><form><p>mail {i}</p></form><p>Every page has this line.</p><p>{b}<br>next</p></article>
<section id="comments"><article class="comment"><p>I like {i}</p></article></section><footer>&copy; {i}</footer>"""

DIVS = """<html><body><div class="top"><a href="/a">home</a> <a href="/b">news</a></div><div class="wrap"><div class="post body{i}">
<h1>{a}</h1><p>Share this text</p><p>{b}</p><p>{c}</p></div><div class="side"><p>Latest</p><ul><li><a href="/{i}">{l}</a></li></ul></div></div>
<div class="bottom"><p>All rights reserved</p></div></body></html>"""


def article(i):
    return ARTICLE.format(i=i, a=words(i, 30), b=words(i + 500, 40))


def article_text(i):
    return f"Title {i}\n{words(i, 30)} & bolder <x> a < b\nEvery page has this line.\n{words(i + 500, 40)} next"


def test_articles_with_and_without_a_template(spark):
    rows = [(i, "http://Many.example.org:80/x", article(i)) for i in range(12)] + [(50, "https://one.example.org", article(50)), (51, None, article(51))]
    got = run(spark, rows)
    for i in [*range(12), 50, 51]:
        assert got[i] == (article_text(i), len(article_text(i)))


def test_slots_of_a_template_without_article_elements(spark):
    rows = [(i, "//divs.example.org/", DIVS.format(i=i, a=words(i, 6), b=words(i + 100, 60), c=words(i + 200, 50), l=words(i + 300, 4))) for i in range(10)]
    rows.append((10, "//divs.example.org/", article(10)))  # another layout on the same host
    got = run(spark, rows)
    for i in range(10):
        assert got[i][0] == "\n".join([words(i, 6), words(i + 100, 60), words(i + 200, 50)])
    assert got[10][0] == article_text(10)


def test_copies_of_one_article_keep_their_text(spark):
    rows = [(i, "http://copies.example.org/", article(3)) for i in range(8)]
    rows += [(100 + i, "http://same.example.org/", "<html><body><div><p>one text</p><p>in all pages</p></div></body></html>") for i in range(8)]
    got = run(spark, rows)
    assert {got[i][0] for i in range(8)} == {article_text(3)}
    assert {got[100 + i][0] for i in range(8)} == {"one text\nin all pages"}


def test_flags_do_not_take_the_only_article():
    for page in ('<form id="main-form"><article><p>a</p></article></form>', "<nav><main><p>a</p></main>", '<div class="has-sidebar"><article>a</article></div>'):
        assert H.main_text(Page(page), None, frozenset(), False) == "a"
    assert H.main_text(Page("<p>a <span class=ad>x</span>b</p><p hidden>c</p><div style='display: none'>d</div>"), None, frozenset(), False) == "a b"


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>{words(i, 20)}</p>" for i in range(20_000)) + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "", ""), (None, "http://h/", "<p>x"), (3, "http://h/", long), (4, "http://h/", deep), (5, "not a url", " \n "), (5, "not a url", " \n "),
            (6, "http://h/", "<p>a<script>never closed <p>b"), (7, "http://h/", "x <!-- open <p>y"), (8, "http://h/", "<a href='x>y</a><p>z"), (9, "http://h/", "a<b"),
            (10, "http://h/", "</p></div></x>&amp&#x41;&#0;&nosuch;"), (11, "http://h/", "<article></article><p>out</p>"), (12, "http://h/", "<svg><p>in</svg><svg/><p>ä  b")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = H.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and sum(r.page_id == 5 for r in out) == 2
    assert got[1] == got[2] == got[5] == "" and got[None] == "x" and got[3].count("\n") == 19_999 and got[4] == "deep"
    assert got[6] == "a" and got[7] == "x" and got[9] == "a" and got[11] == "" and got[12] == "ä b"
    assert got[10] == "&A�&nosuch;"
    assert all(r.n_chars == len(r.text) for r in out)
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_pages(spark, sf):
    """Another reading of the given pages: the first article element cut by its tags."""
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inside))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
