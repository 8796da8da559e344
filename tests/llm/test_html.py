"""What the cut decides, odd pages, long pages, and the query on its table against a plain reading."""

import html as std
import re
import time

import numpy as np
import pytest

from brineloom.llm import html as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def article(page):
    inside = page.split("<article>", 1)[-1].split("</article>")[0]
    blocks = [" ".join(std.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_the_query_equals_a_plain_reading_of_its_pages(spark, pages):
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = H.op9(spark, SF).collect()
    assert len(got) == len(html)
    for r in got:
        assert r["text"] == article(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_smoothness_decides_blocks(pages):
    """Without edges a block's own text decides, and most pages come out wrong; with them all come out right."""
    rows = [r["html"] for r in pages.limit(60).collect()]
    weights = H.learn(pages)
    wrong, changed = {0.0: 0, 1.0: 0}, 0
    for html in rows:
        sides = []
        for smooth in wrong:
            page = H.read(html)
            H.label(page, weights, smooth)
            sides.append([b.content for b in page.blocks])
            wrong[smooth] += "\n\n".join(b.text for b in page.blocks if b.content) != article(html)
        changed += sum(a != b for a, b in zip(*sides, strict=True))
    assert wrong[1.0] == 0 and wrong[0.0] > len(rows) / 4 and changed > len(rows) / 4


def test_neighbours_decide_where_no_element_says_anything():
    long = "<p>A sentence of the text that is long enough to be taken for one by its own words alone.</p>"
    menu = "".join(f'<p><a href="/{i}">Link {i}</a></p>' for i in range(8))
    page = f"<body><div>{menu}<p>Short words</p>{menu}</div><div>{long * 4}<p>Short words</p>{long * 4}</div></body>"
    weights = (-1.2, 2.6, -4.0, 0.4, 0.0, 0.0)
    for smooth, kept in ((0.0, 8), (1.0, 9)):
        got = H.read(page)
        H.label(got, weights, smooth)
        assert sum(b.content for b in got.blocks) == kept
    assert [b.content for b in got.blocks if b.text == "Short words"] == [False, True]


BODY = "<p>The first paragraph of the article has a number of words.</p><p>So it goes.</p>"
TEXT = "The first paragraph of the article has a number of words.\n\nSo it goes."


@pytest.mark.parametrize(
    "page",
    [
        f"<main>{BODY}</main><aside><p>Other things that one may read, in a long sentence of its own.</p></aside>",
        f'<div class="page has-sidebar"><article>{BODY}</article><div class="sidebar"><p>Not this sentence of the side, however long it is.</p></div></div>',
        f'<div class="sidebar-layout"><article>{BODY}</article></div>',
        f'<article><svg width="1" viewBox="0 0 1 1"/>{BODY}</article><footer><p>The footer says a long sentence about itself.</p></footer>',
        f"<article><svg><path/><text>no</text></svg><video><p>never shown</p></video>{BODY}</article>",
        f"<article><object data=x>{BODY}</article>",
        f"<article><button>Share<p>The first paragraph of the article has a number of words.</p><p>So it goes.</p></article>",
        f"<article><select><option>a<option>b</select>{BODY}</article><!-- <p>no</p> -->",
        f"<article>{BODY}<section class=comments><p>I, a reader, say a long sentence.</p><p>So do I, and it is as long as that one.</p></section></article>",
        f"<article>{BODY}<div style='display: none'><p>Hidden sentence that nobody is meant to read here.</p></div></article>",
        f"<article>{BODY}<aside><article><p>A teaser of another article, of many words and more.</p></article></aside></article>",
        f'<div role="main">{BODY}</div><div role="navigation"><p>Not this sentence either, it is long but a menu.</p></div>',
        f"<noscript><p>Turn on your scripts to read this.</p></noscript><article>{BODY}<script>'<p>x</p>'</article>",
    ],
)
def test_structures(page):
    assert H.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == TEXT


def test_lists_and_tables_of_an_article_stay_and_headers_go():
    page = "<article><header><h1>Title</h1><p>By a writer, on a day</p></header><p>Words of it.</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><pre> x  y </pre></article>"
    assert H.main_text(page).split("\n\n") == ["Title", "Words of it.", "one", "two", "a", "b", "c", "x y"]


def test_long_pages_take_seconds():
    rng = np.random.default_rng(0)
    page = "<body>" + "".join(f"<p>{'word ' * int(rng.integers(1, 30))}.</p>" if rng.random() < 0.6 else f"<ul><li><a href=x>link {i}</a></li></ul>" for i in range(50_000))
    began = time.process_time()
    got = H.read(page)
    H.label(got)
    assert len(got.blocks) == 50_000 and time.process_time() - began < 15
    began = time.process_time()
    H.min_cut((rng.normal(size=10_000) * 0.3).tolist(), [(i, i + 1, 0.6) for i in range(9_999)] + [(i, i + 2, 0.3) for i in range(9_998)])
    assert time.process_time() - began < 15


def test_null_repeated_and_no_rows(spark):
    page = f"<article>{BODY}</article>"
    x = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "no markup of any kind in this text.")], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_blocks")
    got = sorted(((r["page_id"] or 0, r["url"], r["text"]) for r in H.extract(x).collect()), key=str)
    assert got == sorted([(1, "u", TEXT), (1, "u", TEXT), (2, None, ""), (0, "v", ""), (3, "w", "no markup of any kind in this text.")], key=str)
    assert H.extract(x.where("false")).count() == 0
