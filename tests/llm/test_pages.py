"""Main-text extraction: pages of known articles in many layouts, malformed and very long pages, and votes by plain counting."""

import random
import time
from html import escape

import pytest

from refrain.llm import html_extract
from refrain.llm.html_extract import Page
from refrain.llm.markup import tokens

SCHEMA = "page_id long, url string, html string"
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul>'
SAYS = "<p>A reader says at great length that the article is wrong in every respect, and goes on and on about it without an end.</p>"

#: Where {a} is the article's markup: blocks of known text. None of the rest is main text.
LAYOUTS = {
    "article": f"<html><body><nav>{MENU}</nav><article>{{a}}</article><footer>(c) us</footer></body></html>",
    "main with aside": f"<body><header><div>Logo</div></header><main>{{a}}</main><aside>{SAYS}</aside></body>",
    "div content": f'<body><div class="top-menu">{MENU}</div><div id="content">{{a}}</div><div class="sidebar">{SAYS}</div></body>',
    "nested divs": f'<body><div class="wrap"><div class="row has-sidebar"><div class="col-8">{{a}}</div><div class="col-4 sidebar-right">{SAYS}</div></div></div></body>',
    "table": f"<body><table><tr><td width=100>{MENU}</td><td>{{a}}</td></tr></table></body>",
    "comments": f'<article>{{a}}</article><section id="comments"><article class="comment">{SAYS}</article><article class="comment">{SAYS}{SAYS}{SAYS}</article></section>',
    "notice and form": '<div class="cookie-notice">We use cookies.</div><div class="story">{a}<form><label>Your name</label><select><option>Mr<option>Ms</select><textarea>x</textarea></form></div>',
    "adverts": '<div id="page"><div class="ad-slot">Buy now!</div><section>{a}</section><div class="advertisement">Buy more, and more, and more!</div></div>',
    "related by id": '<article id="related-work">{a}</article><nav>Next</nav>',
    "class says free": '<div class="comment-free-story">{a}</div><div class="share-buttons"><a href=x>Share</a></div>',
    "suspect holds all": '<div class="widget">{a}</div>',
    "title outside": '<div class="page"></div><div class="sidebar">Side.</div><div class="widget-text">{a}<p>And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on. And so it goes on.</p></div>',
    "short article": '<div class="ad">Buy this thing, it is a very good thing to buy, and it is cheap.</div><article>{a}</article><div class="notice">This site, like any other, has something to say about cookies.</div>',
    "roles": f'<div role="banner"><p>Site</p></div><div role="main">{{a}}</div><div role="complementary">{SAYS}</div><div role="contentinfo">(c)</div>',
    "hidden": '<div>{a}</div><div hidden><p>Hidden words of some length that nobody sees.</p></div><div style="display: none"><p>Neither these.</p></div>',
    "scripts": '<script>if (a<b) document.write("<p>no</p>")</script><style>p{{}}</style><div>{a}<script>more("</div>")</script></div><noscript>Enable scripts.</noscript>',
    "unclosed": f"<body><nav>{MENU}</nav><article>{{a}}",
    "upper case": f"<BODY><NAV>{MENU}</NAV><ARTICLE>{{a}}</ARTICLE><FOOTER>(c)</FOOTER></BODY>",
    "wrong end tags": "</div></p><div></span>{a}</article></div><footer>end</footer>",
}


def article(rng, n=6):
    """(markup, text) of some blocks."""
    marked, plain = [], []
    for k in range(n):
        words = [rng.choice(("stone", "river", "a", "the", "é", "1 < 2", "R&D", "“so”", "math")) for _ in range(rng.randrange(8, 40))]
        text = " ".join(words)
        body = escape(text, quote=False).replace("é", rng.choice(("é", "&eacute;", "&#233;"))).replace(" ", rng.choice((" ", "\n", "  ", "\t ")))
        kind = rng.choice(("p", "p", "unclosed p", "inline", "h2", "blockquote", "math", "link", "list"))
        if kind == "inline":
            body = f"<p>{body[:0]}<b>{body}</b></p>"
        elif kind == "math":
            body, text = f"<p>{body} <math><mi>x</mi><mo>+</mo><mi>y</mi></math></p>", text + " x+y"
        elif kind == "link":
            body, text = f'<p>{body} <a href="/x?a=1&amp;b=2" title="a > b">more</a></p>', text + " more"
        elif kind == "list":
            body, text = f"<ul><li><a href=/s1>{body}</a><li><a href=/s2>source</a></ul>", text + "\nsource"
        elif kind == "unclosed p":
            body = f"<p>{body}"
        else:
            body = f"<{kind}>{body}</{kind}>"
        marked.append(body)
        plain.append(text)
    return "".join(marked), "\n".join(plain)


@pytest.mark.parametrize("name", LAYOUTS)
def test_articles_of_known_text(name):
    rng = random.Random(name)
    for _ in range(12):
        marked, plain = article(rng)
        if name not in ("article", "main with aside", "comments", "related by id", "unclosed", "upper case"):
            while "<ul>" in marked:  # a list of links alone is a menu, outside an article
                marked, plain = article(rng)
        if name == "title outside":
            plain += "\n" + " ".join(["And so it goes on."] * 15)
        assert Page(LAYOUTS[name].replace("{{", "{").replace("}}", "}").replace("{a}", marked)).text(None) == plain


def test_short_article_beside_a_longer_advert():
    assert Page('<div class="ad">Buy this thing, it is a very good thing to buy.</div><article><h1>Title</h1><p>Short.</p></article>').text(None) == "Title\nShort."


def test_winning_paths_are_those_of_plain_counting(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        marked, _ = article(rng, rng.randrange(1, 5))
        layout = rng.choice(list(LAYOUTS.values()))
        rows.append((k, f"https://h{k % 4}.example/{k}", layout.replace("{a}", marked)))
    votes = {}
    for _, url, html in rows:
        for path, share in Page(html).scores().items():
            v = votes.setdefault(url.split("/")[2], {}).setdefault(path, [0, 0])
            v[0] += int(share * 1_000_000 + 0.5)
            v[1] += 1
    want = {host: max(v, key=lambda p: (*v[p], p)) for host, v in votes.items()}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.host: r.path for r in html_extract.winning_paths(df).collect()} == want
    for hosts in (100, 0):
        got = {r.page_id: r.text for r in html_extract.extract_text(df, broadcast_hosts=hosts).collect()}
        assert got == {k: Page(h).text(want[u.split("/")[2]]) for k, u, h in rows}


def test_page_without_text_at_the_winning_path_is_read_elsewhere(spark):
    page = "<body><div class=c><p>{}</p></div></body>"
    rows = [(k, "http://a.example/x", page.format("some words of an article " * 5)) for k in range(5)]
    rows.append((9, "http://a.example/y", "<body><div class=c></div><div class=d><p>The article is elsewhere.</p></div></body>"))
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[9] == "The article is elsewhere."


def test_columns_with_clashing_names_and_nulls(spark):
    rows = [(1, "http://a.example", "<p>one</p>", "x", "y", "z"), (None, None, None, None, None, None), (2, "no host", "", "a", "b", "c"), (1, "http://a.example", "<p>one</p>", "x", "y", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _path string, host string, text string")
    found = html_extract.extract_text(df)
    assert found.columns == ["page_id", "url", "html", "_path", "host", "text"]
    assert sorted((r.page_id or 0, r.text, r._path or "", r.host or "") for r in found.collect()) == [(0, "", "", ""), (1, "one", "x", "y"), (1, "one", "x", "y"), (2, "", "a", "b")]


@pytest.mark.parametrize(
    "html",
    [
        "<a" * 500_000, '<a href="' * 110_000, "<a " * 330_000, "<div>" * 200_000 + "x", "<" * 1_000_000, "<!--" * 250_000, "</p>" * 250_000, "<p><center>" * 90_000, "<td><center>" * 90_000, "<a b='" * 160_000 + ">",
        "<script>" * 120_000, "<li><address>" * 70_000, "<div>" * 100_000 + "</section>" * 90_000, "<a " + "=" * 1_000_000 + ">", "<select><option>a" * 50_000, "</" * 500_000, "<dl>" + "<dd><pre>" * 100_000, "&" * 1_000_000, "<div class='" + "a1 " * 300_000 + "'>x",
    ],
    ids=lambda h: h[:14],
)
def test_a_megabyte_of_anything_takes_seconds(html):
    began = time.time()
    Page(html).text(None)
    assert time.time() - began < 20  # some two seconds on an idle machine


def test_tokens_of_odd_markup():
    def read(html):
        return [(t, tag, closing, attrs) for t, tag, closing, attrs in tokens(html)]

    assert read("1 < 2 <b>x</b> <") == [("1 < 2 ", "b", False, {}), ("x", "b", True, {}), (" <", "", False, {})]
    assert read("<a b=\"1>2\" c='x\"' d=e f>t") == [("", "a", False, {"b": "1>2", "c": 'x"', "d": "e", "f": ""}), ("t", "", False, {})]
    assert read('a<p id="x>b') == [("a", "p", False, {"id": '"x'}), ("b", "", False, {})]
    assert read("a<!-- <p> -->b<!doctype x>c<?y?>d</ >e") == [("abcde", "", False, {})]
    assert read("<SCRIPT>a</p></script >b") == [("", "script", False, {}), ("a</p>"[:0], "script", True, {}), ("b", "", False, {})]
    assert read("x<p") == [("x", "", False, {})]
    assert read("<p a=1 A=2/>") == [("", "p", False, {"a": "1"}), ("", "", False, {})]
