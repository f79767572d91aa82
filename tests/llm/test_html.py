"""Main text against the article element of the given pages and against labelled templates."""

import html as entities
import re

import pytest
from pyspark.sql import functions as F

from sieveline.llm import html
from sieveline.llm.html_examples import PAGES
from sieveline.llm.queries import QUERIES
from sieveline.session import local_frame


@pytest.fixture(scope="module")
def tree(spark):
    return html.fit_tree(html.labelled_blocks(spark))


def article(page):
    found = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|br)\s*/?>", found[1]) if found else []
    texts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_query_matches_the_articles(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op1_main_text"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        have = got[r["page_id"]]
        assert have["url"] == r["url"] and have["text"] == article(r["html"]) and have["n_chars"] == len(have["text"])


def test_tree_learns_its_table(tree):
    for page in PAGES:
        found = html.blocks(page)
        assert [b[0] for b in found if b[0][0] == "+"] == html.main_text(page, tree).split("\n")


BODY = "A paragraph of the article with more than a few words in it."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("   ", ""), ("<html></html>", ""), ("<", "<"), ("<p", ""), ("a < b", "a < b"),
        (f"<article><p>{BODY} &lt;b&gt; caf&eacute; &#233; &#x1F600; &amp;amp; &copy 2020 &am</article>", f"{BODY} <b> café é \U0001f600 &amp; © 2020 &am"),
        (f"<article><p> {BODY}\n\t  and&nbsp;more <b>bold</b>text<br>next</p><p></p><p>x</article>", f"{BODY} and more boldtext next\nx"),
        (f'<article><script>if (a < b) {{ "</p>" }}</script><p>{BODY}<style>p {{}}</style></p><!-- <p>no</p> --><noscript>n</noscript></article>', BODY),
        (f"<article><p title='a > b' data-x=\"<p>\">{BODY}</p><p title=\"broken>{BODY} Two.</p></article>", f"{BODY}\n{BODY} Two."),
        (f"<body></div></nav></article><article><div><p>{BODY}</div></section><p>{BODY}</article></article><footer>f</footer>", f"{BODY}\n{BODY}"),
        (f"<BODY><NAV>menu</NAV><ARTICLE><H1>Title</H1><P>{BODY}</ARTICLE><FOOTER>end</FOOTER>", f"Title\n{BODY}"),
        (f'<article><p>{BODY}</p><div class="user-comments"><p>{BODY} says a reader</p></div><form>mail <input type="text"></form></article>', BODY),
        (f'<div id="cookie-notice">{BODY}</div><article><p>{BODY}</p></article><div class="ad-box">{BODY}</div><aside>{BODY}</aside>', BODY),
        (f"<article><p>{BODY}<script>never closed", BODY),
        (f'<article><p>{BODY} <svg class="i"/>more <math/>and<button disabled />more</p><svg><text>no</text></svg><p>x</p></article>', f"{BODY} more andmore\nx"),
        (f'<article class="legal"><p>{BODY}</p><p class="ad">{BODY}</p><p>x</p><p id="comment">{BODY}</p></article>', f"{BODY}\nx"),
        (f'<article class="post-notice"><p>{BODY} <span class="ad">Buy</span>two.</p></article><article class="comment">{BODY}</article>', f"{BODY} two."),
        (f'<div class="content has-sidebar"><article><p><span class="ad">Buy <b>now</b></span>{BODY}</p></article></div>', BODY),
        (f'<article><p>{BODY} <span class="ad">one <span>two</span><p>{BODY}</span>three</article>', f"{BODY}"),
    ],
)
def test_cases(tree, page, want):
    assert html.main_text(page, tree) == want


def test_rows_and_long_pages(spark, tree):
    long = "<article>" + "<p>word and more words</p>" * 20_000 + "<div>" * 50_000 + "</span>" * 50_000
    rows = [(1, "u", long), (2, None, None), (2, None, None), (None, "x", "<article><p>a b</p></article>"), (3, "u", "&lt;" * 100_000)]
    pages = local_frame(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html.extract(pages, tree).collect()
    assert len(got) == 5
    by = {r["page_id"]: r for r in got}
    assert by[1]["n_chars"] == 20_000 * 20 - 1 and by[2]["text"] == "" and by[None]["text"] == "a b" and by[3]["n_chars"] == 100_000
    assert html.extract(pages.limit(0), tree).count() == 0
