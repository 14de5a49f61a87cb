"""Main text of pages: the given pages against a plain reading, small pages against their text."""

import html
import re
import time

import pytest

from llm.cases import SF_DIR, prose
from numberboard.llm.article import extract_pages, main_text

SCHEMA = "page_id long, url string, html string, text string, n_chars string, score double"
LONG = prose(40, 21) + ", and " + prose(30, 22) + "."


def plain(page):
    """What stands between the article tags of the given pages, cut at paragraphs."""
    inside = re.split(r"</article>|<footer>", page.split("<article>", 1)[1])[0]
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(x for x in parts if x)


def test_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    expected = {(r["page_id"], r["url"], plain(r["html"])) for r in pages.collect()}
    found = extract_pages(pages).collect()
    assert {(r["page_id"], r["url"], r["text"]) for r in found} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in found) and len(found) == pages.count()


CASES = {
    "menus, headers, sidebars, notices, adverts, forms and comments go": (
        f"<body><header><h1>Site</h1><p>{LONG}</header><div id=topMenu>{LONG}</div><nav><p>{LONG}</nav>"
        f"<div class='cookie-notice'><p>{LONG}</p></div><div class=content><h1>Title</h1><p>One, {LONG}</p>"
        f"<div class='ad-slot'><p>{LONG}</div><p>Two.</p><form><p>Write: <input><button>Go</button></form>"
        f"<script>x='<p>no</p>'</script><style>p{{}}</style></div><aside><p>{LONG}</aside>"
        f"<section class=comments><article><p>{LONG}, {LONG}</article></section><footer>{LONG}</footer>",
        f"Title\nOne, {LONG}\nTwo.",
    ),
    "an article keeps all its parts": (
        f"<main><ul><li><a href=/>a</a><li><a href=/>b</a><li><a href=/>c</a></ul><article><header class=entry-header><h1>T</h1></header>"
        f"<section><p>{LONG}<p>{LONG}</section><section><p>short<ul><li>x<li><a href=/>y</a></ul></section></article></main>",
        f"T\n{LONG}\n{LONG}\nshort\nx\ny",
    ),
    "siblings of the best container": (
        f"<body><div><p>{LONG}, {LONG}<p>{LONG}</div><p>Short end.</p><p><a href=/>a link only.</a></p><div><p>{LONG}</div><div>x</div>",
        f"{LONG}, {LONG}\n{LONG}\nShort end.\n{LONG}",
    ),
    "menus without a tag of their own": (
        f"<div><div><a href=/>{LONG}</a> <a href=/>{LONG}</a> <a href=/>{LONG}</a></div><p>{LONG}</div>",
        LONG,
    ),
    "white space, references and inline tags": (
        "<article><p> a\n\t <b>b&nbsp;&amp;c</b>d<br>e<i></i>f &lt;x&gt; &#233;&eacute &unknown; </p></article>",
        "a b &cd ef <x> éé &unknown;",
    ),
    "a form around the page is the page": (f"<form action=/><div><p>{LONG}</div><input value=x></form>", LONG),
    "an advert inside a line": (f"<article><p>{LONG} <span class=ad>buy</span>end", f"{LONG} end"),
    "unclosed and crossed tags": ("<article><p><b>one<p>two<div>three</p>four</b></div>five</i></article>", "one\ntwo\nthree\nfour\nfive"),
    "cut off in a tag": ("<article><p>one &am</p><p>two <a hre", "one &am\ntwo"),
    "cut off in a comment or a quote": ('<article><p>one <!-- <p>two</p>', "one"),
    "a sign that begins no tag": ("<p>1 < 2 and 3 > 2 <", "1 < 2 and 3 > 2 <"),
    "quoted signs": ("""<article><p title="a>b" lang='>'>one</p>""", "one"),
    "no tags": ("just  text", "just text"),
    "only a title": ("<article><h1>Only</h1></article>", "Only"),
    "no text": ("<html><head><title>t</title></head><body><script>1</script></body>", ""),
    "a layout's name": (f"<div class='page with-sidebar'><div class='post-body'><p>{LONG}</div></div>", LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_small_pages(name):
    page, text = CASES[name]
    assert main_text(page) == text


def test_awkward_rows(spark):
    long_text = prose(200_000, 23)
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", f"<article><p>{long_text}</article>"), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>")]
    found = extract_pages(spark.createDataFrame([(*r, "t", "n", 1.0) for r in rows], SCHEMA)).collect()
    expected = [(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (3, "u", long_text, len(long_text)), (3, "u", "x", 1), (3, "u", "x", 1)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", "<p>" * 100_000 + "x", "<b>" * 50_000 + "</i>" * 50_000 + "x", "<a " * 100_000, '<a href="' * 50_000 + ">", "<i><div>" * 30_000 + "</i>" * 30_000,
     "<!--" * 100_000, "<ul><li>" * 30_000 + "x", "<" * 200_000, "<table><tr><td>" * 20_000 + "x", "&" * 200_000, "<script>" * 50_000, "<form><p>x" * 20_000],
)
def test_time_grows_with_the_length(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 5
