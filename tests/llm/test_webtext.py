"""Main text of pages: planted articles between all kinds of other parts, tolerant reading, and whole tables by the tables' own template."""

import html
import random
import re
import time

import pytest

from arcspan.llm import queries, webtext

WORDS = "river stone, cloud and letter from, winter garden over the quiet, market under small".split()


def para(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


FRAMES = [
    "<body><header class=site-header><h2>Site</h2><p>Motto, of, the, site.</p></header><nav><a href=/>Home</a></nav><main>{a}</main>{x}<footer>(c)</footer></body>",
    "<body class='home has-sidebar'><div id=wrapper><div class=content>{a}</div>{x}</div></body>",
    "<table><tr><td class=menu><a href=a>one</a> <a href=b>two</a></td><td>{a}</td><td class='sidebar-right'>{x}</td></tr></table>",
    "<div class='content-with-sidebar no-ads'>{x}{a}</div>",
]
ARTICLES = ["<article>{h}{p}</article>", "<article class='post tag-newsletter category-comments'><header>{h}</header><div class=body>{p}</div></article>", "<div class='post'>{h}{p}</div>", "<section><div>{h}{p}</div></section>"]
PARTS = [
    "<aside><p>{t}</p></aside>", "<div class='cookie-notice'><p>{t}</p></div>", "<div class=ad><p>{t}</p></div>", "<div id='adSlot_3' class=\"box ad-300x250\">{t}</div>", "<form action=x><p>{t}</p><input name=q><button>Go</button></form>",
    "<section class='comments-area'><h3>Comments</h3><article class='comment even'><p>{t}</p></article><article class='comment odd'><p>{t} {t}</p></article></section>", "<ol class=commentlist><li><p>{t}</p></ol>",
    "<script>var x = '<p>{t}</p>';</script>", "<style>p:after{{content:'{t}'}}</style>", "<!-- <p>{t}</p> -->", "<div role=alert>{t}</div>", "<div style='display: none'><p>{t}</p></div>", "<ul><li><a href=1>{t}</a><li><a href=2>{t}</a></ul>",
    "<noscript><p>{t}</p></noscript>", "<div class='sidebar widget'><p>{t}</p></div>", "<nav class=menu><ul><li>{t}</ul></nav>", "<div hidden><p>{t}</p></div>", "<footer><p>{t}</p></footer>",
]


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("article", ARTICLES)
def test_planted(frame, article):
    r = random.Random(frame + article)
    for k in range(len(PARTS)):
        parts = [para(r, r.choice([3, 40, 90])) for _ in range(r.choice([1, 2, 6]))]
        title = "On " + para(r, 4)
        extra = "".join(x.format(t=para(r, 30)) for x in r.sample(PARTS, 3) + [PARTS[k]])
        inner = "".join(f"<p>{x}</p>" for x in parts)
        page = "<!DOCTYPE html><html><head><title>t</title></head>" + frame.format(a=article.format(h=f"<h1>{title}</h1>", p=inner), x=extra)
        assert webtext.main_text(page) == " ".join([title, *parts]), page


def test_parts_inside_the_article():
    page = "<article><h1>A</h1><p>First, of all, this.</p><div class='share-buttons'><a>Tweet</a> Share</div><p>Then more, of it.</p><div id=comments><p>I, for one, agree, fully, with, all, of, this.</p></div></article>"
    assert webtext.main_text(page) == "A First, of all, this. Then more, of it."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), (" \n\t", ""), ("just words\n  here", "just words here"), ("<p>", ""), ("<script>x", ""), ("<!-- open <p>x</p>", ""),
        ("a &lt;b&gt; &amp c &#233;&#x2713; &nope; &nbsp; d", "a <b> & c é✓ &nope; d"), ("1 < 2 and 3 > 2 <p>x", "1 < 2 and 3 > 2 x"), ("<p>one<p>two<br>lines<p>three", "one two lines three"),
        ("<p>one<b>bold</b>word <i>x</p><p>next", "oneboldword x next"), ("<p title='a > b' data-x=\"</p>\">in</p>", "in"), ("<P>UP</P><SCRIPT>no</script >yes", "UP yes"), ("<div>a<div>b</div>c</div>", "a b c"),
        ("<ul><li>one<li>two</ul><p>t", "one two t"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("</div></p></b>x", "x"), ("<b><p>x</b>y</p>z", "xy z"), ("<p>a<textarea><p>no</textarea>b", "ab"),
        ("<p>cut off <a href='x", "cut off"), ("<p/>x<br/>y<img src=a>z", "x yz"), ("<a name=x/>linked</a> <p>text, here", "linked text, here"), ("<p>\x00a\x0bb</p>", "\x00a b"), ("<svg><title>t</title></svg><p>v", "v"),
    ],
)
def test_reading(page, text):
    assert webtext.main_text(page) == text


def test_deep_and_long_pages_are_linear():
    began = time.time()
    deep = "<div>" * 60000 + "<p>inside, deep</p>"
    assert webtext.main_text(deep) == "inside, deep"
    assert webtext.main_text("<div><table><td>" + "<i>" * 30000 + "</div>" * 30000 + "x") == "x"
    assert len(webtext.main_text("<article>" + "<p>word, " * 60000)) == 60000 * 6 - 1
    webtext.main_text("<a b=\"" * 30000), webtext.main_text("<!--" * 60000), webtext.main_text("<" * 300000), webtext.main_text("<p><b>" * 30000)
    assert time.time() - began < 30


def by_template(page):
    """The text of a page of the test tables, whose article is marked."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    blocks = re.split(r"<h1>|</h1>|</?p>", inner[1]) if inner else []
    return " ".join(x for x in (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in blocks) if x)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {x.page_id: (x.url, by_template(x.html)) for x in pages.collect()}
    got = queries.op12_html(spark, sf).collect()
    assert len(got) == len(want)
    assert {x.page_id: (x.url, x.text) for x in got} == want and all(x.n_chars == len(x.text) for x in got)


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a", "x", 1), (1, "u", "<p>a", "x", 1), (None, None, None, None, None), (2, "", "", "", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(repr, map(tuple, webtext.extracted(df).collect()))) == sorted(map(repr, [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, "", "", 0)]))
    assert webtext.extracted(df.where("page_id > 9")).collect() == []
