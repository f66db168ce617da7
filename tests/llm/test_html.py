"""Main text of pages against articles written out by hand."""

import html
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crosstide.llm import catalog, html_content

LONG = "This is a sentence, with a comma, that goes on for a while. Another one follows; it is plain, too. " * 3
ARTICLE = [f"First. {LONG}".strip(), "Short.", f"Second &amp; third. {LONG}".strip(), f"Fourth. {LONG}".strip()]
WANT = " ".join(["The heading", *(html.unescape(p) for p in ARTICLE)])
BODY = "<h1>The heading</h1>" + "".join(f"<p>{p}</p>" for p in ARTICLE)
COMMENT = f"<div class='comment'><p>Reader: {LONG}</p><p>{LONG}</p></div>"

PAGES = {
    "article": f"<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body><nav><a href=/>Home</a></nav><article>{BODY}</article><footer>&copy; us</footer></body></html>",
    "plain divs": f"<body><div id=header><a href=/>Site, name.</a></div><div class=menu><ul><li><a>One</a><li><a>Two</a></ul></div><div class='content'>{BODY}</div><div class='sidebar'><p>{LONG}</p></div></body>",
    "comments": f"<body><main>{BODY}<section id='comments'>{COMMENT * 4}</section></main><aside><p>{LONG}</p></aside></body>",
    "notice, form, ad": f"<body><div class='cookie-notice'><p>{LONG}</p></div><form><p>{LONG}</p><textarea>{LONG}</textarea></form><div class='post'>{BODY}<div class=ad>Buy, now!</div></div></body>",
    "named body": f"<body class='has-sidebar'><div class='layout sidebar-left'><div class=text>{BODY}</div><div class='related-posts'><p>{LONG}</p></div></div></body>",
    "not closed": f"<html><body><nav><ul><li><a>x<li><a>y</ul></nav><article><h1>The heading<br></h1><p><b>{ARTICLE[0]}<p>{ARTICLE[1]}<p>{ARTICLE[2]}<p>{ARTICLE[3]}",
    "white space": f"<article>\n <h1>The\n  heading</h1>" + "".join(f"<p>\t{p.replace(' ', chr(10))} </p>\n" for p in ARTICLE) + "</article>",
    "hidden, comment, quoted >": f"<body><!-- <p>{LONG}</p> --><div hidden><p>{LONG}</p></div><article><div title='a>b'>{BODY}</div></article><noscript><p>{LONG}</p></noscript></body>",
    "one section": f"<body><article><header><h1>The heading</h1></header><section>{''.join(f'<p>{p}</p>' for p in ARTICLE)}</section></article></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    assert " ".join(html_content.content_blocks(PAGES[name])) == WANT


BULK = "".join(f"<p>{p}</p>" for p in ARTICLE * 8)
PARTS = f"<h1>The heading</h1><p>A lead of few words</p><div class=body>{BULK}</div><p>Closing words</p>"
ANCHORS = "<h2 id=related-work>Related work</h2><p id=notice>One line.</p><section id=search-results><p>What was found, in short.</p></section><h2 id=social-impact>Impact</h2>"
LISTS = "<div class=related-posts><ul><li><a href=/a>Another post</a></li><li><a href=/b>One more</a></li></ul></div>"


@pytest.mark.parametrize("page", [f"<main>{PARTS}</main>", f"<div class=page>{PARTS}</div>", f"<body><nav><a href=/>Home</a></nav><main><div>{PARTS}</div></main><footer>us</footer></body>"])
def test_heading_lead_and_closing_beside_a_long_body(page):
    bulk = " ".join(html.unescape(p) for p in ARTICLE * 8)
    assert " ".join(html_content.content_blocks(page)) == f"The heading A lead of few words {bulk} Closing words"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_names_of_sections_are_no_furniture(tag):
    page = f"<body><{tag}>{BODY}{ANCHORS}<p>{LONG}</p>{LISTS}</{tag}></body>"
    assert " ".join(html_content.content_blocks(page)) == f"{WANT} Related work One line. What was found, in short. Impact {LONG.strip()}"


def test_an_article_of_links_and_a_section_named_search():
    assert html_content.content_blocks("<article><p><a href=/a>Only a link text in the article</a></p></article>") == ["Only a link text in the article"]
    assert html_content.content_blocks("<body><nav><a href=/>Home</a></nav><p><a href=/a>Link</a></p></body>") == []
    for name in ("search", "related", "social", "share"):
        page = f"<body><article>{BODY}<section class='{name}'><p>What one finds. {LONG}</p></section></article></body>"
        assert " ".join(html_content.content_blocks(page)) == f"{WANT} What one finds. {LONG.strip()}"
        links = f"<body><article>{BODY}<section class='{name}'><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></section></article></body>"
        assert " ".join(html_content.content_blocks(links)) == WANT


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(" ".join(html.unescape(re.sub(r"</?b>", "", part)) for part in re.split(r"</?(?:p|h1|br)>", inner)).split())


@pytest.mark.parametrize("opened,closed", [("<div>", "</div>"), ("<div class=story>", "</div>"), ("", "")])
def test_given_pages_without_their_article_element(spark, opened, closed):
    """Words found and words right, where no element says which text is the article."""
    right = found = wanted = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        page = r["html"].replace("<article>", opened).replace("</article>", closed)
        got, want = (Counter(x.split()) for x in (" ".join(html_content.content_blocks(page)), article_of(r["html"])))
        right, found, wanted = right + (got & want).total(), found + got.total(), wanted + want.total()
    print(opened, right / found, right / wanted)
    assert right / found > 0.95 and right / wanted > 0.95


def test_odd_pages(spark):
    texts = [None, "", "<", "<p", "just text, no tags. " * 3, "<p>a" * 3_000, "</div></p>", "<script>never closed", "&amp &lt;b&gt; &#x41;&nbsp;z", "<a " + "x" * 200_000, "<a '" * 2_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None)], "page_id long, html string").withColumn("text", F.lit(1))
    out = {r["page_id"]: r["text"] for r in html_content.with_main_text(df).collect()}
    assert out[0] == out[1] == out[6] == out[7] == "" and out[4] == ("just text, no tags. " * 3).strip()
    assert out[5] == " ".join(["a"] * 3_000) and out[8] == "& <b> A z"
    assert html_content.with_main_text(df.limit(0)).count() == 0


def test_given_pages(spark):
    for r in catalog.op5_html_text(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", part)) for part in re.split(r"</?(?:p|h1|br)>", inner))
        assert r["text"] == " ".join(want.split()) and r["n_chars"] == len(r["text"])
