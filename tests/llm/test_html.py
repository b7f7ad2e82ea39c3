"""HTML extraction against the texts that generated pages were made of."""

import random
import time
from html import escape

import pytest

from corpusloom.llm import html

SCHEMA = "page_id long, url string, html string"


def page(rng, n):
    """(html, article text): an article with nested blocks among the furniture of a site."""
    word = lambda: rng.choice(["plain", "größe", "a&b", "x<y", "“q”", "related", "comment", "menu", "1.5"])
    some = lambda k: " ".join(word() for _ in range(rng.randint(1, k)))
    title, blocks, out = some(5), [], []
    for _ in range(n):
        kind, t = rng.choice(["p", "div", "ul", "quote", "table", "inline", "figure"]), some(30)
        e = escape(t) if rng.random() < 0.5 else escape(t).replace("ö", "&ouml;").replace("“", "&#8220;").replace("”", "&#x201D;")
        blocks.append(t)
        if kind == "ul":
            u = some(4)
            blocks.append(u)
            out.append(f"<ul><li>{e}<li>{escape(u)}</ul>")
        else:
            out.append({"p": f"<p>{e}\n", "div": f"<div class='lead'><div> {e}</div></div>", "quote": f"<blockquote><p>{e}</p></blockquote>", "table": f"<table><tr><td>{e}</table>", "inline": f"<p><b>{e[:0]}</b>{e.replace(' ', ' <i></i>', 1)}<!-- x --></p>", "figure": f"<figure><figcaption>{e}</figcaption></figure>"}[kind])
        if rng.random() < 0.2:
            out.append(rng.choice(["<script>var a = '<p>no</p>';</script>", "<div class='ad'>buy</div>", "<form><input value=x>send</form>", "<aside>more</aside>", "<style>p{}</style>"]))
    body = f"<header><h1>{escape(title)}</h1></header>" + "".join(out) + "<div class='comments'><p>great post</p></div>"
    furniture = ["<header id='top'>Site</header>", "<nav><ul><li><a href=/>home</a></ul></nav>", "<div class='cookie-notice'>accept</div>", "<div id='sidebar'>links</div>"]
    rng.shuffle(furniture)
    return "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(furniture) + f"<article>{body}</article><footer>end</footer></body></html>", " ".join([title, *blocks])


@pytest.mark.parametrize("seed", [1, 2])
def test_op6_generated_pages(spark, seed):
    rng = random.Random(seed)
    made = [page(rng, rng.randint(1, 40)) for _ in range(60)]
    rows = [(i, f"http://h{i % 4}.org/{i}" if i % 9 else None, h) for i, (h, _) in enumerate(made)]
    out = {r.page_id: r for r in html.extracted(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for i, (_, text) in enumerate(made):
        assert out[i].text == text and out[i].n_chars == len(text)


@pytest.mark.parametrize("few", [50_000, 0])
def test_op6_host_votes_odd_rows_and_clashes(spark, monkeypatch, few):
    monkeypatch.setattr(html, "FEW_HOSTS", few)
    good = "<body><div class=story><p>" + "the story goes on " * 20 + "</div><div class=other>short</div></body>"
    odd = "<body><div class=story><p>brief</div><div class=other>" + "a much longer list of other things " * 9 + "</div></body>"
    rows = [(i, f"http://a.b/{i}", good) for i in range(5)] + [(9, "http://a.b/9", odd), (9, "http://a.b/9", odd), (10, None, None), (11, "http://a.b/x", ""), (12, "x", "just words"), (None, "http://a.b", "<p>cut of")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA + ", text string, _path int")
    out = sorted(((r.page_id, r.text) for r in html.extracted(df).collect()), key=str)
    assert out == sorted([*((i, " ".join(["the story goes on"] * 20)) for i in range(5)), (9, "brief"), (9, "brief"), (10, ""), (11, ""), (12, "just words"), (None, "cut of")], key=str)
    assert html.extracted(df.limit(0)).count() == 0


def test_op6_keeps_what_is_no_furniture():
    assert html.extract("<article><p>E is <math><mi>x</mi></math> ok <svg><text>s</text></svg> <object>alt</object></p></article>", None) == "E is x ok s alt"
    assert html.extract("<article><header><h1>Title</h1></header><p>text</p><footer>by me</footer></article>", None) == "Title text"
    assert html.extract("<article><p class='related-work'>prior art</p><p class='related-links'>see also</p><p class='adapter'>a</p><p class='ad-box'>b</p></article>", None) == "prior art a"
    assert html.extract("<body><div class='comment-list'>no</div><article class='post comment-open'>yes</article></body>", None) == "yes"


@pytest.mark.parametrize("make", [lambda n: "<body>" + "<div class=x><p>t</p></div>" * n, lambda n: "<body>" + "<b>" * n + "</i>" * n + "t", lambda n: "<div>" * n + "t", lambda n: "<body>" + "<p>t" * n, lambda n: "<i>" * n + "<p>t" * n])
def test_op6_time_is_linear(make):
    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        html.extract(make(n), "body>div.x")
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0] + 0.5
