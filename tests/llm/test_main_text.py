"""Main text of pages, against the article of the given pages and of pages built here."""

import html
import re

import pytest

from stratalake.llm.main_text import extract, main_text


def article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1)[^>]*>", body)
    plain = (" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks)
    return "\n\n".join(b for b in plain if b)


def test_whole_table(table):
    for r in main_text(table("pages")).collect():
        assert r.text == article(r.html)


PARTS = (
    "<h1>A title</h1><p>First paragraph, with some text. More &amp; more.<p>Second <a href=x>linked</a> one, good.<ul><li>one item<li>two item</ul>"
    "<blockquote>Quoted, text.</blockquote><p>Last&nbsp;one\n  here, done.</p>"
)
TEXT = "A title\n\nFirst paragraph, with some text. More & more.\n\nSecond linked one, good.\n\none item\n\ntwo item\n\nQuoted, text.\n\nLast one here, done."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=/>Home, now.</a></nav><article>{PARTS}</article><footer>(c) 2024, all rights.</footer></body></html>",
        f"<body><header><h1>Site, name.</h1></header><div class=main>{PARTS}</div><div id='sidebar'><p>Popular posts, and. such, things.</p></div>",
        f"<div class='wrap'><div class='ad-box ad'>Buy now, cheap.</div><main>{PARTS}</main><div class='comments'><p>Nice, thanks. Long, long.</p></div></div>",
        f"<div role=navigation><p>Menu, here.</div><div class=content>{PARTS}</div><form>Name, please. <input></form><script>var x='<p>no, no.</p>'</script>",
        f"<div id=cookie-notice><p>We use cookies, ok. Really, we do.</p></div><section>{PARTS}</section><aside><p>Related, things.</aside>",
        f"<!-- <p>hidden, text.</p> --><style>p{{x:y}}</style><article>{PARTS}<div class=share>Share, it.</div></article>",
        f"<article><header></header>{PARTS}<section id='comments'><p>First, comment. Long, text.</p></section></article><p hidden>No, never.</p>",
    ],
)
def test_layouts(page):
    assert extract(page) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body>{PARTS}</html>",
        f"<html><head><title>T</title><div>{PARTS}</div></html>",
        f"<body><nav>Home</nav><div class='post type-post tag-python tag-news'>{PARTS}</div>",
        f"<body><div id=content class='has-sidebar no-comments'>{PARTS}</div><div class=sidebar><p>Popular posts, and. such, things.</p></div>",
        f"<body><div class=related>{PARTS}</div><div class=share>Share, it.</div>",
        f"<body><div class='notice-box'><article>{PARTS}</article></div><div class=comments><p>{'Long talk, with no end. ' * 40}</p></div>",
        f"<form id=aspnetForm><div class=menu><p>Home, and more.</p></div><div>{PARTS}</div><div class=site-footer>(c), all rights.</div></form>",
        f"<body><div class=related><article>A teaser, short.</article></div><article>{PARTS}</article><form><p>Your name, please.</p></form>",
        f"<div class=menu><p>Home, and more.</p></div><div class='main'>{PARTS.replace('some text', '<span class=notice>some</span> <em class=share>text</em>')}</div>",
    ],
)
def test_named_elements_that_hold_the_article(page):
    assert extract(page) == TEXT


def test_text_that_is_all_in_named_elements():
    assert extract("<div class=ad><p>One, two.</p></div><div class=promo><p>Six, ten.</p></div>") == "One, two.\n\nSix, ten."


LONG = ("A long paragraph, with many words. It goes on, and on, without an end, for a while. " * 6).strip()


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div id=content><h1>Title</h1><p>Intro.</p><div class=body><p>{LONG}</p><p>{LONG}</p></div><p>End.</p></div>", ["Title", "Intro.", LONG, LONG, "End."]),
        (f"<main><section><p>{LONG}</p><p>{LONG}</p></section><section><p>Second.</p></section></main>", [LONG, LONG, "Second."]),
        (f"<main><section>{f'<p>{LONG}</p>' * 6}</section><section><p>{LONG}</p></section></main>", [LONG] * 7),
        (f"<article><h1>T</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div></article>", ["T", LONG, LONG]),
        (f"<div class=x><h1>T</h1><p>Intro.</p><ul><li>{LONG}<li>{LONG}</ul><p>End.</p></div>", ["T", "Intro.", LONG, LONG, "End."]),
        (f"<div class=x><h2>T</h2><div>{LONG}</div><div>End.</div></div>", ["T", LONG, "End."]),
        (f"<div class=x><p>Intro.</p><table><tr><td>{LONG}<td>{LONG}</table><p>End.</p></div>", ["Intro.", LONG, LONG, "End."]),
        (f"<div class=x><p>Intro.</p><div class=body><p>{LONG}</p><p>{LONG}</p></div></div>", ["Intro.", LONG, LONG]),
        (
            f"<div><div><a href=/>Home</a></div><div class=x><h2><a href=x>Title</a></h2><p>{LONG}</p><p><a href=y>All link</a></p>"
            f"<ul><li><a href=z>Item</a></ul><p>{LONG}</p></div></div>", ["Title", LONG, "All link", "Item", LONG],
        ),
        (
            f"<body><div><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div><div><p>{LONG}</p><p>{LONG}</p></div>"
            "<div><ul><li><a href=/>Top</a></ul></div>", [LONG, LONG],
        ),
    ],
)
def test_whole_article(page, text):
    assert extract(page) == "\n\n".join(text)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<p>a", "a"), ("plain text", "plain text"), ("<div><div", ""), ("<br/>&lt;b&gt; x", "<b> x"),
        ("<p>a<b>b</b>c <i>d</i>", "abc d"), ("<p>x < y and z", "x < y and z"), ("<script>x", ""), ("<p>a<script>b</script>c", "ac"),
        ("<p title='a>b'>t", "t"), ("<p>&eacute;&#233;&#xe9;&nope;", "ééé&nope;"), ("<p>a<!-- c", "a"), ("</p></div>t", "t"),
    ],
)
def test_broken_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><h1>Head</h1><img alt="5" tall"><p>One, two.</p><p>Three, four.</p></article>', "Head\n\nOne, two.\n\nThree, four."),
        ("<p>a <a href=x title=don't>link</a> and more</p><p>second, one</p>", "a link and more\n\nsecond, one"),
        ("<p title=a'b>one</p><p>two</p><p title='c'>three</p>", "one\n\ntwo\n\nthree"),
        ("<p title = \"a>b\" x='>' y=/z>one</p><p =odd>two</p>", "one\n\ntwo"),
        ("<p class='a'id=\"b\">one</p><p a=b/>two", "one\n\ntwo"),
    ],
)
def test_quotes_in_tags(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    "page",
    [
        f"<div class=post><header>{PARTS.replace('</h1>', '</h1></header>')}</div>",
        f"<body><header>Site, all of it.</header><div id=page><div class=post><header>{PARTS.replace('</h1>', '</h1></header>')}</div></div>",
        f"<body><header><h1>Site</h1></header><article>{PARTS}</article>",
        f"<body><header><h1>Site</h1></header><article>{PARTS.replace('h1>', 'h2>')}</article>",
    ],
)
def test_headlines_in_headers(page):
    assert extract(page) == TEXT


@pytest.mark.parametrize("name", ["comment-thread", "user-comment", "reader-comments", "comments"])
def test_comments_as_long_as_the_article(name):
    page = f"<article>{PARTS}<div class={name}><p>{LONG}</p><p>{LONG}</p></div></article>"
    assert extract(page) == TEXT


@pytest.mark.parametrize("name", ["side-bar", "related-articles", "alert", "author-bio", "author-box", "sidebar", "related-stories"])
def test_boxes_inside_an_article(name):
    assert extract(f"<article>{PARTS}<div class={name}><p>Some words here, of another kind. More of them.</p></div></article>") == TEXT


def test_deep_nesting_is_bounded():
    import time
    import tracemalloc

    for page in ("<div>" * 20_000 + "end", "<div>a" * 16_000, "<b>" * 30_000 + "x", "<ul><li>" * 10_000 + "y" + "</nope>" * 10_000, "<form>x" * 14_000):
        tracemalloc.start()
        start = time.perf_counter()
        text = extract(page)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert text and peak < 300e6 and time.perf_counter() - start < 60
    assert extract("<div>a" * 2000).count("a") == 2000


def test_long_page():
    page = "<article>" + "<p>Some words, in a row. And more.</p>" * 30_000 + "</article>" + "<div>" * 5000
    assert extract(page).count("\n\n") == 29_999


def test_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "old", 2), (1, "u", None, "old", 2)], "page_id long, url string, html string, text string, part int")
    got = main_text(pages)
    assert [(r.page_id, r.text, r.part) for r in got.collect()] == [(1, "a", 2), (1, "", 2)]
    assert main_text(pages.limit(0)).count() == 0
