import time

import pytest
from tidelog.llm.html_extract import FEATURES, blocks, decide, extract, features, main_text, train

TREE = train()
P = "word " * 30


def w(n):
    return " ".join(f"w{i}" for i in range(n))


def a(n):
    return f"<a href='/x'>{w(n)}</a>"


#: Pages that the tree has not seen: (label, markup) of their blocks, with markup between them under ".".
HELD_OUT = {
    "wrapper named for its header": [(".", "<div class='page has-header'>"), ("+", f"<h1>{w(6)}</h1>"), ("+", f"<p>{w(120)}</p>"), ("+", f"<p>{w(20)}</p>"), (".", "</div>")],
    "wrapper named for its sidebar": [(".", "<div class='container has-sidebar'>"), ("+", f"<h1>{w(3)}</h1>"), ("+", f"<p>{w(60)}</p>"), ("+", f"<p>{w(60)}</p>"), (".", "</div><div class='sidebar'>"), ("-", f"<p>{w(25)}</p>"), (".", "</div>")],
    "free of adverts": [(".", "<div class='ad-free story'>"), ("+", f"<h1>{w(2)}</h1>"), ("+", f"<p>{w(120)}</p>"), (".", "</div>")],
    "menu without a class": [("-", f"<div>{w(7)}</div>"), (".", "<div>"), ("+", f"<h1>{w(3)}</h1>"), ("+", f"<p>{w(80)}</p>"), ("+", f"<p>{w(40)}</p>"), (".", "</div>")],
    "advert cell": [(".", "<table><tr><td>"), ("+", f"<h1>{w(4)}</h1>"), ("+", f"<p>{w(75)}</p>"), ("+", f"<p>{w(44)}</p>"), (".", "</td>"), ("-", f"<td>{w(10)}</td>"), (".", "</tr></table>")],
    "lines around an article": [("-", f"<p>{w(7)}</p>"), (".", "<article>"), ("+", f"<h1>{w(5)}</h1>"), ("+", f"<p>{w(90)}</p>"), ("+", f"<p>{w(3)}</p>"), (".", "</article>"), ("-", f"<div>{w(10)}</div>"), ("-", f"<p>{w(35)}</p>")],
    "comments of an open article": [(".", "<body class='comments-open'><article class='post comments-open'>"), ("+", f"<h1>{w(4)}</h1>"), ("+", f"<p>{w(18)}</p>"), (".", "<div class='comment-list'>"), ("-", f"<p>{w(60)}</p>"), ("-", f"<p>{w(5)}</p>"), (".", "</div></article></body>")],
    "own header": [(".", "<article><header class='entry-header'>"), ("+", f"<h1>{w(8)}</h1>"), (".", "</header>"), ("+", f"<p>{w(50)}</p>"), (".", "<div class='social-share'>"), ("-", f"<p>{w(4)}</p>"), (".", "</div>"), ("+", f"<p>{w(12)}</p>"), (".", "</article>")],
    "paragraphs as divisions": [("-", f"<div>{a(1)} {a(2)} {a(1)}</div>"), ("+", f"<h1>{w(7)}</h1>"), ("+", f"<div>{w(64)}</div>"), ("+", f"<div>{w(41)} {a(3)} {w(8)}</div>"), ("+", f"<div>{w(33)}</div>"), ("-", f"<div>{a(4)}</div>"), ("-", f"<div>{a(6)}</div>")],
    "link list": [(".", "<div>"), ("+", f"<h1>{w(5)}</h1>"), ("+", f"<p>{w(70)}</p>"), ("+", f"<p>{w(25)}</p>"), (".", "</div><div>"), ("-", f"<p>{a(5)}</p>"), ("-", f"<p>{a(6)}</p>"), ("-", f"<p>{a(4)}</p>"), (".", "</div>")],
    "notices": [("-", f"<div class='gdpr-consent'>{w(45)}</div>"), (".", "<div class='content'>"), ("+", f"<h2>{w(6)}</h2>"), ("+", f"<p>{w(85)}</p>"), ("+", f"<p>{w(6)}</p>"), ("+", f"<p>{w(30)}</p>"), (".", "</div>"), ("-", f"<div class='newsletter-signup'>{w(20)}</div>"), ("-", f"<footer>{w(30)}</footer>")],
    "short article": [("-", f"<nav>{a(2)} {a(1)}</nav>"), (".", "<article>"), ("+", f"<h1>{w(3)}</h1>"), ("+", f"<p>{w(2)}</p>"), (".", "</article>"), ("-", f"<div class='advert'>{w(30)}</div>")],
    "links in an article": [(".", "<main>"), ("+", f"<h1>{w(3)}</h1>"), ("+", f"<p>{w(40)}</p>"), ("+", f"<p>{a(4)}</p>"), ("+", f"<p>{w(22)}</p>"), (".", "</main>"), ("-", f"<p>{a(3)}</p>")],
}


@pytest.mark.parametrize("name", sorted(HELD_OUT))
def test_held_out_pages(name):
    found, want = blocks("".join(m for _, m in HELD_OUT[name])), [mark == "+" for mark, _ in HELD_OUT[name] if mark != "."]
    assert [not b.at.strict and decide(TREE, r) for b, r in zip(found, features(found), strict=True)] == want


def test_tree_uses_words_and_densities_of_neighbours():
    used = set()

    def walk(t):
        if not isinstance(t, bool):
            used.add(FEATURES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(TREE)
    assert {"words_before", "words_after", "density_before", "density"} <= used


def test_time_grows_with_the_page():
    def took(page):
        began = time.process_time()
        blocks(page)
        return time.process_time() - began

    for make in (lambda n: "<div>" * n + "</b>" * n, lambda n: "<p>\u0130</p>" + "<script>x</SCRIPT>" * n, lambda n: "<div class='nav'>" * n + "<p>x" * n + "</div>" * n):
        assert took(make(40_000)) < 30 * max(took(make(4_000)), 0.005)


def test_blocks():
    page = "<p a='>'>one  &amp;amp;\n two<br>three<b>x</b></p><!-- no --><script>if (a<b) '</p>'</script><td>f&ouml;r</td><style>p{}</style><p>open <i>it"
    assert [b.text for b in blocks(page)] == ["one &amp; two threex", "för", "open it"]
    assert [(b.words, b.linked) for b in blocks("<p>a <a href=x>b c</a> d</p>")] == [(4, 2)]
    assert [b.text for b in blocks("plain < text & more <")] == ["plain < text & more <"]
    assert blocks(None) == blocks("") == blocks("<p> <br> </p>") == []
    assert [b.text for b in blocks("<p>a</p><script>never closed <p>b")] == ["a"]
    assert [b.text for b in blocks("x<!-- open <p>y")] == ["x"]


def test_skipped_elements_end_in_any_case():
    for tag in ("script", "STYLE", "Title"):
        page = f"<p>\u0130stanbul</p><{tag}>x</{tag.swapcase()}><p>after"
        assert [b.text for b in blocks(page)] == ["\u0130stanbul", "after"], tag


def test_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title></head><body class="has-sidebar"><header><p>{P}</p></header><nav><a href=/>home</a></nav>
    <div id="cookie-banner">{P}</div><div class="wrap sidebar-right"><article><header><h1>Title here</h1></header><p>{P}<p>short<br>one &lt;b&gt;</p>
    <div class="ad">{P}</div><ul><li>item</li></ul></article><div class="comments"><article>{P}</article></div></div>
    <aside>{P}</aside><form>{P}</form><div style="display: none">{P}</div><footer>{P}</footer></body></html>"""
    assert main_text(page, TREE).split("\n") == ["Title here", P.strip(), "short one <b>", "item"]


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>"), (2, None, None), (3, "", ""), (None, "u", "<nav>x</nav>"), (4, "v", "<article>" + f"<p>{P}</p>" * 20_000), (1, "u", f"<article><p>{P}</p></article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted(((r.page_id or 0, r.n_chars, len(r.text)) for r in extract(frame).collect()))
    n = len(P.strip())
    assert got == [(0, 0, 0), (1, n, n), (1, n, n), (2, 0, 0), (3, 0, 0), (4, 20_000 * (n + 1) - 1, 20_000 * (n + 1) - 1)]
    assert extract(frame.limit(0)).count() == 0
