"""Drawings, formulas, selections and templates in an article: closed, self-closed and never closed.

The article's formulas and drawings are its text, but for their titles; selections and templates aren't.
"""

import time

import pytest

from indexloom.llm import html_main

PARA = "A sentence of some length, with words. And another one follows it, longer still. "
WANT = f"Head {PARA}{PARA}{PARA}".strip()


@pytest.fixture(scope="module")
def model():
    return html_main.trained()


@pytest.mark.parametrize(("odd", "words"), [
    ("", ""), ("<svg class='i'/>", ""), ("<svg class=i />", ""), ("<math/>", ""),
    ("<svg viewBox='0 0 1 1'><title>icon</title><g><path d='M0'/></g></svg>", ""),
    ("<p>Here <math><mi>x</mi><mo>=</mo><mn>12</mn></math> stands, as it should.</p>", "Here x=12 stands, as it should. "), ("<select><option>one<option selected>two</select>", ""),
    ("<template><p>hidden words</p><li>more</template>", ""), ("<svg><foreignObject><div><p>Drawn words, with more words after them.</p></div></foreignObject></svg>", "Drawn words, with more words after them. "),
    ("<template><svg><p>hidden</p></svg></template>", ""), ("<p>See <svg><svg><text>inner </text></svg><text>outer</text></svg> and so on.</p>", "See inner outer and so on. "),
    ("<svg><path d='M0'>", ""), ("<math><mi>", ""), ("<select><option>one", ""), ("<svg><svg>", ""), ("<math><mi><svg>", ""),
    ("<div><template><p>hidden words</p></div>", ""), ("<div><svg></div>", ""),
])
def test_the_rest_of_the_article_stays(model, odd, words):
    page = f"<body><nav><a href=/>Home</a></nav><article><h2>Head</h2><p>{PARA}</p>{odd}<p>{PARA}</p><p>{PARA}</p></article><footer><p>(c) 2024</p></footer></body>"
    assert html_main.main_texts([page], model) == [f"Head {PARA}{words}{PARA}{PARA}".strip()]


def test_a_drawing_within_a_paragraph(model):
    for odd in ("<svg/>", "<svg class=i></svg>", "<svg><path d=x>"):
        page = f"<article><h2>Head</h2><p>{PARA}{odd}</p><p>{PARA}</p><p>{PARA}</p></article>"
        assert html_main.main_texts([page], model) == [WANT]


def test_templates_lie_outside_the_lists_around_them():
    f = html_main.Forest()
    f.add("<ul><li>one<template><li>hidden<p>hidden</template> still one<li>two</ul>")
    assert [t for t in f.text if t] == ["one", " still one", "two"]
    assert [html_main.TAGS[t] if t < len(html_main.TAGS) else "?" for t in f.tag] == ["html", "ul", "li", "#text", "#text", "li", "#text"]


def test_many_open_drawings_keep_the_stack_short():
    start = time.time()
    for odd in ("<svg>", "<svg><g>", "<template>", "<select><option>", "<svg><p>"):
        html_main.Forest().add("<div>" * 300 + odd * 5_000 + "x" + "</g></p></svg>" * 5_000)
    assert time.time() - start < 30
