"""Main text of pages: planted pages with their own text, tree matching against brute force."""

import random
import re
from functools import lru_cache
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import TABLES

from adhere.llm import dom
from adhere.llm import html_extract as H
from adhere.llm import queries

SCHEMA = "page_id long, url string, html string, host string, text string, slot int"


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], SCHEMA)
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    return found


def text_of(spark, html, url="http://a.example/1"):
    return extracted(spark, [(1, url, html)])[0].text


WORDS = "amber birch cedar delta ember fjord grove heath islet joint knoll larch maple north ocean pearl".split()


def sentence(rng, n=14):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(rng):
    return [sentence(rng, 5)] + [sentence(rng, rng.randrange(12, 40)) for _ in range(rng.randrange(3, 9))]


def links(rng, n):
    return "".join(f'<li><a href="/{rng.random()}">{sentence(rng, 2)}</a></li>' for _ in range(n))


def semantic(rng, body):
    head, *rest = body
    return (f"<!doctype html><html><head><title>{head}</title><script>if(a<b)x('</p>')</script></head><body class='p{rng.random()}'>"
            f"<header class=site><a href=/>Home</a><p>{sentence(rng)}</p></header><nav><ul>{links(rng, 5)}</ul></nav>"
            f"<div class='cookie-notice'><p>{sentence(rng)}</p><button>Accept</button></div>"
            f"<main><article><header><h1>{head}</h1><p class=byline>By {sentence(rng, 2)}</p></header>"
            + "".join(f"<p>{p}" for p in rest[:2]) + f"<aside><p>{sentence(rng)}</p></aside>"
            f"<div class='ad-slot'><p>{sentence(rng)}</p></div>" + "".join(f"<p>{p}</p>" for p in rest[2:])
            + f"<div><p>Read on in our paper</p></div><form><label>Mail</label><input><p>{sentence(rng)}</p></form>"
            f"<footer>{sentence(rng)}</footer></article>"
            f"<section id=comments>" + "".join(f"<article class=comment><p>{sentence(rng)}</p></article>" for _ in range(9))
            + f"</section></main><aside class=sidebar><ul>{links(rng, 9)}</ul><p>{sentence(rng)}</p></aside>"
            f"<footer><p>{sentence(rng)}</p></footer></body></html>")


def unnamed(rng, body):
    """No element tells its part: only what varies and what is linked does."""
    head, *rest = body
    return (f"<html><body><div><p>The Daily Knoll, since 1901</p></div><div><ul>{links(rng, 12)}</ul></div>"
            f"<div><div><h1>{head}</h1>" + "".join(f"<p>{p}</p>" for p in rest)
            + "</div><div><p>Sign our petition for more larches in the parks of the north, it takes a minute</p></div></div>"
            f"<div><p>All rights are with the owners of this paper and of these words</p></div></body></html>")


def bare(rng, body):
    """Text right in cells, as of old; entities, line breaks and inline marks inside."""
    head, *rest = body
    return (f"<table><tr><td class=menu>{links(rng, 4)}<td><font size=2><h2>{head}</h2>"
            + "".join(f"<br>\n<b>{p[:9]}</b>{p[9:]}<div></div>" for p in rest)
            + f"</font><tr><td colspan=2 class=footer>{sentence(rng)}</table>")


@pytest.mark.parametrize("build", [semantic, unnamed, bare])
def test_articles_of_planted_hosts(spark, build):
    rng = random.Random(5)
    bodies = [article(rng) for _ in range(30)]
    rows = [(i, f"https://{build.__name__}.example/{i}", build(rng, b)) for i, b in enumerate(bodies)]
    got = {r.page_id: r.text.split("\n") for r in extracted(spark, rows)}
    assert got == dict(enumerate(bodies))


def test_copies_are_no_template(spark):
    # Most pages of the host are copies of one article, whole or with one paragraph changed.
    rng = random.Random(6)
    one = article(rng)
    bodies = [one] * 20 + [[*one[:2], sentence(rng), *one[2:]] for _ in range(3)] + [article(rng) for _ in range(6)]
    rows = [(i, f"http://b.example/{i}", semantic(rng, b)) for i, b in enumerate(bodies)]
    got = {r.page_id: r.text.split("\n") for r in extracted(spark, rows)}
    assert got == dict(enumerate(bodies))


def test_one_page_of_a_host(spark):
    rng = random.Random(7)
    body = article(rng)
    assert text_of(spark, semantic(rng, body)).split("\n") == body[:1] + body[1:] + ["Read on in our paper"]


CASES = {
    "<article><p>a &amp; b&nbsp;c &#233; &eacute; &lt;p&gt; &am x</p></article>": "a & b c é é <p> &am x",
    "<article><p>one\n\t two<br>three <b>four</p><p>five</article>six": "one two three four\nfive",
    "<article>loose <p>in</p> end</article>": "loose\nin\nend",
    "<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table></article>": "a\nb\nc\nd\ne",
    "<article><!-- <p>no</p> --><p>yes<script>'</article><p>no'</script></p><style>p{}</style></article>": "yes",
    "<ARTICLE><P CLASS='x>y' data-a=\"<p>\">kept</P></ARTICLE>": "kept",
    "<article><p>open <a href='x": "open",
    "<article><p hidden>no<p style='display: none'>no<p aria-hidden=true>no<p>yes</article>": "yes",
    "<div class='has-sidebar no-comments'><p>whole words only: headerless, adder, commented</p></div>":
        "whole words only: headerless, adder, commented",
    "<article><h1>a</h1></article><article class=comment><p>b</article>": "a",
    "just text": "just text",
    "<p>x</p></p></div></article><p>y": "x\ny",
    "": "", "<nav>a</nav>": "", "<article></article>": "", "<script>x": "", "<!-- open": "", "<": "<",
}


def test_small_pages(spark):
    rows = [(i, f"http://h{i}.example/", html) for i, html in enumerate(CASES)]
    got = {r.page_id: r.text for r in extracted(spark, rows)}
    assert got == dict(enumerate(CASES.values()))


def test_nulls_repeats_and_empty_tables(spark):
    page = "<article><p>a</p></article>"
    got = extracted(spark, [(1, None, page), (1, None, page), (None, "no host", page), (2, "http://x/", None), (3, "http://x/", "")])
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "a"), (1, "a"), (1, "a"), (2, ""), (3, "")]
    assert extracted(spark, []) == []


def test_very_long_and_deep_pages(spark):
    rng = random.Random(8)
    long = [sentence(rng, 30) for _ in range(5000)]
    rows = [(1, "http://l.example/1", "<article>" + "".join(f"<p>{p}</p>" for p in long) + "</article>"),
            (2, "http://l.example/2", "<div>" * 3000 + "deep" + "</div>" * 3000),
            (3, "http://l.example/3", "<article>" + "".join(f"<div>{p}</div><div><p>{p}</div>" for p in long) + "</article>"),
            (4, "http://l.example/4", "<article>" + "<b>" * 5000 + "x" * 10 ** 6 + "<p>y</article>")]
    got = {r.page_id: r.text for r in extracted(spark, rows)}
    assert got[1].split("\n") == long and got[2] == "deep"
    assert got[3].split("\n") == [p for p in long for _ in (0, 1)] and got[4] == "x" * 10 ** 6 + "\ny"


def test_given_pages(spark):
    rows = queries.queries()["op13_html_extract"](spark, TABLES).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert r.text == "\n".join(filter(None, (" ".join(unescape(p).split()) for p in parts)))


def test_host_names(spark):
    urls = ["HTTP://User:x@A.Example:80/p?q", "http://a.example", "//b/c", None, "https://é.example/#x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(H.host_of("url").alias("h"))
    assert [r.h for r in df.collect()] == ["a.example", "a.example", "", "", "é.example"]


# Simple tree matching against its definition, on small trees.

TREES = st.recursive(st.sampled_from("abc").map(lambda x: (x, ())),
                     lambda t: st.tuples(st.sampled_from("abc"), st.lists(t, max_size=3).map(tuple)), max_leaves=7)


def slot(t):
    s = dom.Slot(t[0])
    s.kids = [slot(k) for k in t[1]]
    s.reshape()
    return s


@lru_cache(maxsize=None)
def largest(a, b):
    if a[0] != b[0]:
        return 0

    @lru_cache(maxsize=None)
    def best(i, j):
        if i == len(a[1]) or j == len(b[1]):
            return 0
        return max(best(i + 1, j), best(i, j + 1), largest(a[1][i], b[1][j]) + best(i + 1, j + 1))
    return 1 + best(0, 0)


@settings(max_examples=300, deadline=None)
@given(TREES, TREES)
def test_matching_is_largest(a, b):
    x, y = slot(a), slot(b)
    assert dom.matching(x, y) == largest(a, b)
    place = dom.places(x, y)
    assert sum(p is not None for p in place) == largest(a, b)
    pairs = [(p, k) for k, p in enumerate(place) if p is not None]
    assert pairs == sorted(pairs) and dom.from_shape(x.shape).shape == x.shape
    wide = slot(a)
    if a[0] == b[0]:
        dom.merge(wide, slot(b))
        assert sum(1 for _ in wide.walk()) == sum(1 for _ in x.walk()) + sum(1 for _ in y.walk()) - largest(a, b)
