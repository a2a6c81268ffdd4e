"""Main texts of generated pages whose articles are known, and what must not cost an article its text."""

from __future__ import annotations

import random
import time

import pytest

from tests.llm.test_small import words
from tidewater.llm import html_text

PAGES = "page_id long, url string, html string"
SECTIONS = ["discussion", "response", "related work", "search", "notice", "hidden gems", "social-science", "promotion", "replies"]


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], PAGES)
    return [r["text"] for r in sorted(html_text.main_text(df).collect(), key=lambda r: r["page_id"])]


def article(rng, seed):
    """Blocks of an article as HTML and as text."""
    blocks = [f"<h1>{words(4, seed)}</h1>"]
    want = [words(4, seed)]
    for k in range(rng.randint(4, 9)):
        t, s = words(rng.randint(15, 60), 1000 * seed + k), words(5, 1000 * seed + 500 + k)
        kind = rng.choice(["p", "p", "p", "list", "quote", "section", "svg", "fixed", "div"])
        if kind == "p":
            blocks.append(f"<p>{t.replace(' ', '  ', 1)} <b>{s}</b>" + rng.choice(["", "</p>"]))
            want.append(f"{t} {s}")
        elif kind == "list":
            blocks.append(f"<ul><li>{t}<li>{s}</ul>")
            want += [t, s]
        elif kind == "quote":
            blocks.append(f"<blockquote><p>{t}</p></blockquote>")
            want.append(t)
        elif kind == "section":
            blocks.append(f"<section class='{rng.choice(SECTIONS)}'><h2>{s}</h2><p>{t}</p></section>")
            want += [s, t]
        elif kind == "svg":
            blocks.append(f"<p>{t}</p>" + rng.choice(['<svg width="3"/>', "<svg><svg><path/></svg><text>no</text></svg>"]))
            want.append(t)
        elif kind == "fixed":
            blocks.append("<p>Abstract.</p>")
            want.append("Abstract.")
        else:
            blocks.append(f"<div><h3>{s}</h3><p>{t}</p></div>")
            want += [s, t]
    return "".join(blocks), "\n".join(want)


def page(rng, seed, tagged):
    body, want = article(rng, seed)
    varying = words(12, 77_000 + seed)
    inside = rng.choice(["", f"<div class='comments'><h3>Comments</h3><div class=comment><p>{varying}</p></div></div>", "<div class=share-box>Share this story</div>", f"<aside>{varying}</aside>"])
    box = f"<article>{body}{inside}</article>" if tagged else f"<div id=story>{body}{inside}</div>"
    return (
        f"<!DOCTYPE html><html><head><title>{words(3, seed)}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad-slot>{varying}</div>"
        f"{box}<div class=sidebar><h3>More</h3><p>{varying}</p></div><form><p>Mail</p></form><footer>&copy; us</footer></body></html>"
    ), want


@pytest.mark.parametrize("tagged", [True, False])
def test_generated_articles(spark, tagged):
    rng = random.Random(7 + tagged)
    pages, want = [], []
    for host, n in (("large.org", 30), ("small.org", 6), ("three.org", 3)):
        for i in range(n):
            html, text = page(rng, len(pages) + 1000 * tagged, tagged)
            pages.append((f"http://{host}/{i}", html))
            want.append(text)
    assert texts_of(spark, pages) == want


def test_tagged_articles_read_alone(spark):
    rng = random.Random(3)
    found = [page(rng, 5000 + i, True) for i in range(12)]
    assert texts_of(spark, [(f"http://alone{i}.org/", h) for i, (h, _) in enumerate(found)]) == [w for _, w in found]


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_sections_keep_their_text_whatever_their_name(spark, n):
    pages, want = [], []
    for name in SECTIONS:
        for i in range(n):
            one, two = words(30, i), words(20, 100 + i)
            pages.append((f"http://{name.replace(' ', '-')}.org/{i}", f"<article><h1>T {i}</h1><p>{one}</p><section class='{name}'><h2>Head</h2><p>{two}</p></section><p>{one[::-1]}</p></article>"))
            want.append(f"T {i}\n{one}\nHead\n{two}\n{one[::-1]}")
    assert texts_of(spark, pages) == want


@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_paragraphs_that_pages_repeat_stay(spark, n):
    """At every size of the host."""
    pages = [(f"http://h.org/{i}", f"<article><h1>{words(3, i)}</h1><h2>Abstract</h2><p>Abstract.</p><p>{words(30, i)}</p><div><h2>Notes</h2><p>Yes.</p><p>{words(40, 50 + i)}</p></div></article>") for i in range(n)]
    assert texts_of(spark, pages) == [f"{words(3, i)}\nAbstract\nAbstract.\n{words(30, i)}\nNotes\nYes.\n{words(40, 50 + i)}" for i in range(n)]


def test_copies_of_one_page_keep_it(spark):
    html = f"<body><div id=a><h1>T</h1><p>{words(30, 1)}</p><div class=b><p>{words(40, 2)}</p></div></div></body>"
    assert texts_of(spark, [(f"http://copy.org/{i}", html) for i in range(5)]) == [f"T\n{words(30, 1)}\n{words(40, 2)}"] * 5


def test_boxes_that_pages_repeat_go(spark):
    pages = [(f"http://b.org/{i}", f"<article><p>{words(30, i)}</p><div><p>Share this story</p></div><p class=imprint>Printed by us</p><p>{words(30, 90 + i)}</p></article>") for i in range(4)]
    assert texts_of(spark, pages) == [f"{words(30, i)}\n{words(30, 90 + i)}" for i in range(4)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article><p>one word here</p><svg width="3"/><p>two words here</p></article>', "one word here\ntwo words here"), ("<article><p>a</p><svg><path><p>b</p></article>", "a\nb"), ("<article><p>a<svg><svg></svg><text>no</text></svg> c</p><p>b</p></article>", "a c\nb"),
        ("<article><p>a</p><iframe src=x><p>b</p></article>", "a\nb"), ("<article><p>a</p><noscript><p>b</p></article>", "a\nb"), ("<article><p>a</p><noscript>no</noscript><p>b</p></article>", "a\nb"), ("<article><p>a</p><script>x = '<p>no</p>'", "a"),
        ("<article><p>a</p><textarea>no</textarea><p>b</p><textarea><p>c</p></article>", "a\nb\nc"),
    ],
)
def test_raw_elements_swallow_no_article(spark, html, text):
    assert texts_of(spark, [("http://x.org/", html)]) == [text]


def test_reader_comments_and_link_lists_go_by_name(spark):
    parts = ["<div class=comments><h3>Comments</h3><p>me too and more</p></div>", "<section class=responses><h3>2 responses</h3><div class=response><p>first one</p></div></section>", "<div class=related><h3>Related</h3><p><a href=1>link text one</a></p><p><a href=2>link text two</a></p></div>", "<div class=search><h3>Search</h3><form><p>Mail</p></form></div>"]
    assert texts_of(spark, [(f"http://n{i}.org/", f"<article><p>{words(30, i)}</p>{x}</article>") for i, x in enumerate(parts)]) == [words(30, i) for i in range(len(parts))]


def test_many_unclosed_elements_take_linear_time():
    t = time.time()
    for tag in ("title", "svg", "iframe", "svg/"):
        html_text.stream(f"<p>x<{tag}>" * 30_000)
    assert time.time() - t < 10
