import html
import itertools
import re

import numpy as np
import pytest

from indexloom.llm import html_main


@pytest.fixture(scope="module")
def model():
    return html_main.trained()


def article(source):
    """Brute force for these pages: what stands in the article element."""
    s = source or ""
    i, j = s.find("<article>"), s.find("</article>")
    s = s[i + 9 : j if j >= 0 else len(s)] if i >= 0 else ""
    s = re.sub(r"</?(b|i|em|span|a)(\s[^>]*)?>", "", s)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", "\n", s)).split())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op8_equals_brute_force(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = [(r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages.collect()]
    assert sorted(map(tuple, html_main.extract(pages).collect()), key=str) == sorted(want, key=str)


def test_other_layouts(model):
    para = "A sentence of some length, with words. And another one follows it, longer still. "
    pages = {
        f"<body><header class=top><h1>Site</h1></header><div class='menu'><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></div><div id=content><h1>Title &amp; more</h1><p>{para}</p><p>{para}</p></div><aside class=sidebar><h3>Also</h3><ul><li><a href=x>Read this</a></li></ul></aside><div class=comments><h2>Comments</h2><div class=comment><b>Jo</b><p>I like it.</p></div></div><footer><p>&copy; 2024 All rights.</p></footer></body>": f"Title & more {para}{para}",
        f"<main><article><h2>Head</h2><p>{para}<p>{para}<ul><li>one thing<li>two things</ul></article></main><form class=search><label>Find</label><input><button>Go</button></form>": f"Head {para}{para}one thing two things",
    }
    for source, want in pages.items():
        assert html_main.main_texts([source], model) == [" ".join(want.split())]


def test_generated_pages(model):
    good = []
    for k in range(120):
        page = html_main._Writer(55_000_000 + k).page()
        f = html_main.Forest()
        f.add(page)
        want = "".join("".join(t.split()) for t in f.text if t and html_main._MARK in t).replace(html_main._MARK, "")
        good.append("".join(html_main.main_texts([page.replace(html_main._MARK, "")], model)[0].split()) == want)
    assert np.mean(good) > 0.9


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(5)
    for _ in range(30):
        f = html_main.Forest()
        f.add("<div><p>a<b>b</b></p><p>c</p></div><ul><li>d")
        n = len(f.tag)
        score = rng.normal(0, 2, n)
        best = None
        for keep in itertools.product([0, 1], repeat=n):
            if all(f.parent[i] < 0 or keep[i] <= keep[f.parent[i]] for i in range(n)):
                value = sum(-np.logaddexp(0, -s) if k else -np.logaddexp(0, s) for k, s in zip(keep, score, strict=True))
                if best is None or value > best[0] + 1e-12:
                    best = (value, keep)
        assert html_main.decode(f, score).astype(int).tolist() == list(best[1])


def test_edge_cases(spark, model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "no tags"), (5, "u", "<p"), (6, "u", "</p></x><<>>&amp;&bogus;"), (7, "u", deep), (8, "u", "<script>never closed"), (9, "u", "<article>" + "<p>word, word. " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    got = html_main.extract(pages.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))).collect()
    assert sorted((r.page_id, r.url) for r in got if r.page_id and r.url) == sorted((r[0], r[1]) for r in rows if r[0] and r[1])
    assert all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "" and by[2] == "" and by[8] == "" and len(by[9]) == 20_000 * 12 - 1
    assert by[6] in ("<<>>&&bogus;", "") and by[7] in ("x", "")
    assert html_main.extract(pages.limit(0)).count() == 0


PARA = "A sentence of some length, with words. And another one follows it, longer still. " * 3


@pytest.mark.parametrize("tag", ["div", "span", "b", "section", "blockquote"])
@pytest.mark.parametrize("depth", [100, 260, 3000])
def test_deep_articles_come_whole(model, tag, depth):
    nest = f"<{tag}>" * depth + f"<p>{PARA}</p>" + f"</{tag}>" * depth
    page = f"<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>{PARA}</p>{nest}<p>{PARA}</p></article><footer><p>&copy; 2024</p></footer>"
    assert html_main.main_texts([page], model) == [" ".join(f"Title {PARA}{PARA}{PARA}".split())]


def test_formulas_and_text_for_other_browsers_stay_in_the_article(model):
    inner = "Let <math><mi>x</mi><mo>=</mo><mn>5</mn></math> be five, <svg><text>so</text></svg> it is <noscript>true</noscript> then."
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{PARA}</p><p>{inner}</p><p>{PARA}</p></article><footer>&copy; 2024</footer>"
    assert html_main.main_texts([page], model) == [" ".join(f"Title {PARA} Let x=5 be five, so it is true then. {PARA}".split())]


@pytest.mark.parametrize("piece", ["<a ", "<a '\"", "<a b=\"", "<a b='c\" ", "\"'", "<p>", "<b>", "<p><b><li>", "</i>", "<div></span>", "<!--", "<!-- x --", "</script", "<script></script ", "<svg><path ", "<select><b>", "<foreignobject><b><div>", "&amp;&", "<", "<td><tr>", "class= <x class=", "<p class=\"class=\" class='>"])
def test_time_follows_length(model, piece):
    import time

    spent = []
    for size in (250_000, 1_000_000):
        page = "<article><p>words, and words.</p>" + piece * (size // len(piece))
        began = time.process_time()
        f = html_main.Forest()
        f.add(page)
        spent.append(time.process_time() - began)
        if piece in ("<a ", "\"'", "<a '\""):
            html_main.main_texts([page], model)
            assert time.process_time() - began < 4
    assert spent[1] < 12 * max(spent[0], 0.05)


def test_stray_marks_lose_no_text(model):
    page = f"<article><h1>One</h1><p>{PARA}</p><p title=\"x\"y' z='>{PARA}</p><p>1 < 2 </ > <3 &lt;b&gt;</p><a href=/x/>link</a><div/><p>{PARA}</p></article>"
    (got,) = html_main.main_texts([page], model)
    assert got == " ".join(f"One {PARA} {PARA} 1 < 2 <3 <b> link {PARA}".split())
