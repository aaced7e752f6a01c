"""Operator 5 on made pages with known articles and on the page table."""

import re
from html import unescape

import pytest

from pairgrid.llm import main_text as M

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="home-%d">
<header><h1>Site name, with words, and commas, quite long</h1></header><nav><ul><li><a href="/a">One, two, three, four, five, six</a></li></ul></nav>
<div class="cookie-notice">We use cookies, many cookies, for all of the things that cookies do on pages.</div>
<div id="wrap"><div class="post post-%d"><h2>Head &amp; line %d</h2><p>First para, with <b>bold</b>&nbsp;text &lt;x&gt; and
 more, more, words<br>after the break.<div class="ad">Buy this, now, and that, later, and everything else in between.</div>
<p>Second, paragraph, no end tag, goes on and on<p>Third &#233;&eacute; with <span class="share">Share this</span>enough, words, to be a paragraph.
<ul><li>item a<li>item b</ul><form><p>Your name, your mail, and your opinion about all of this, please.</p></form>
<blockquote>Quoted, text, of some length, too, is part.</blockquote><table><tr><td>cell 1<td>cell 2</table></div>
<aside><p>Related stories, more of them, other ones, and again some others, to read.</p></aside>
<div class="comments"><div class="comment"><p>Reader comment, that is long, and has many commas, so it, may, look, like, text.</p></div></div></div>
<footer>&copy; all rights, reserved, and so on</footer></body></html>"""
TEXT = ["Head & line %d", "First para, with bold text <x> and more, more, words after the break.", "Second, paragraph, no end tag, goes on and on",
        "Third éé with enough, words, to be a paragraph.", "item a", "item b", "Quoted, text, of some length, too, is part.", "cell 1", "cell 2"]


def test_article_among_noise(spark):
    rows = [(i, f"https://Host{i % 2}.example/x/{i}", PAGE % (i, i, i), "z") for i in range(8)]
    short = '<html><body class="home-1"><div id="wrap"><div class="post post-9"><p>Tiny</p></div><p>A teaser, that is longer, than, the, article, itself, and, so, on.</p></div></body></html>'
    rows += [(20, "https://host0.example/s", short, "z"), (21, "nonsense", "<p>loose text, no container", "z"), (22, None, None, "z"),
             (23, None, "", None), (24, "http://other.example", "<div><p>one</p>" + "<p>word, word</p>" * 20_000, "z"),
             (25, "http://u@broken.example:80/", "<div <p>a < b &am <!-- x", "z"), (None, "http://host0.example", PAGE % (1, 2, 3), "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r for r in M.main_text(df).collect()}
    want = lambda i: "\n\n".join([TEXT[0] % i, *TEXT[1:]])
    for i in range(8):
        assert got[i]["text"] == want(i)
    assert got[None]["text"] == want(3)
    assert got[20]["text"] == "Tiny"  # by the host's path, although the teaser scores more
    assert got[22]["text"] == got[23]["text"] == got[21]["text"] == ""
    assert got[24]["text"] == "one\n\n" + "\n\n".join(["word, word"] * 20_000)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == len(rows)


def test_title_and_lead_beside_a_large_body(spark):
    long = "A long paragraph, with words, and commas, that goes on, and on, about number %d of this page."
    html = ('<html><body><nav><a href="/">Home, and others</a></nav><article><h1>Title %d</h1><div class="lead"><p>The lead of page number %d, in short.</p></div>'
            '<div class="body">' + "".join(f"<p>{long}</p>" for _ in range(4)) + "</div></article></body></html>")
    df = spark.createDataFrame([(i, "http://a.example/", html % ((i,) * 6)) for i in range(5)], "page_id long, url string, html string")
    for r in M.main_text(df).collect():
        i = r["page_id"]
        assert r["text"].split("\n\n") == [f"Title {i}", f"The lead of page number {i}, in short.", *[long % i] * 4]


ARTICLE = "".join(f"<p>Paragraph {i} of the article, with words, and commas, that goes on.</p>" for i in range(4))
WHOLE = "\n\n".join(f"Paragraph {i} of the article, with words, and commas, that goes on." for i in range(4))


@pytest.mark.parametrize("wrap", ['div class="content-sidebar-wrap"', 'div class="has-sidebar"', 'div class="no-comments"', 'div id="with-header"', 'form action="/page.aspx"'])
def test_wrapper_of_the_whole_page_is_no_noise(wrap):
    html = (f'<html><body><{wrap}><div class="post">{ARTICLE}</div><div class="sidebar"><p>Related stories, more, and others.</p></div></{wrap.split()[0]}>'
            '<div class="cookie-notice"><p>We use cookies, as others do too.</p></div></body></html>')
    assert M.extract(html, None) == WHOLE


def test_names_of_noise_still_count():
    html = f'<body><div class="post">{ARTICLE}</div><div class="comments">{"<p>Long, long comment, by some reader, about it.</p>" * 80}</div></body>'
    assert M.extract(html, None) == WHOLE


@pytest.mark.parametrize("start", ["<html><head><title>T</title><meta charset=utf-8><body>", "<html><head><title>T</title><div>", "<html><head><title>T<body>",
                                   "<html><body><button>Menu", "<html><body><noscript>Turn it on", "<html><body><select><option>a<option>b"])
def test_missing_end_tags(start):
    assert M.extract(f'{start}<div class="post">{ARTICLE}</div><button>Send</button>', None) in (WHOLE, f"a\n\nb\n\n{WHOLE}")


def test_page_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in M.main_text(pages).collect()}
    for p in pages.collect():
        inside = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[p["page_id"]] == "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("html", ["<" * 5000, "<a" * 5000, '<div class="' * 3000, "<!--" * 5000, "<p>" * 20000, "&" * 5000, "<div>" * 3000 + "x"])
def test_broken_pages_end(html):
    M.extract(html, None)


def test_empty(spark):
    assert M.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
