"""The scanner's time follows the page's length, whatever is left open."""

import random
import time

import pytest

from indexloom.llm import html_main

TAGS = sorted({*html_main.CLOSES_P, *html_main.SEALED, *html_main.HOLDS_BLOCKS, *html_main.DROPPED, *html_main.CLOSES, *html_main.INLINE, *html_main.VOID, "table", "tbody", "ul", "button", "body"})


def scan(source):
    f = html_main.Forest()
    began = time.time()
    f.add(source)
    return time.time() - began


@pytest.mark.parametrize("start, one, other", [("<dl><dt><dl>", "<div>", "<dt></dt>"), ("<svg><foreignobject>", "<span>", "<p></p>"), ("<table><tr>", "<b>", "<td></td></p>"), ("", "<ul><li>", "</ol><li></li>")])
def test_a_megabyte_of_what_closes_nothing(start, one, other):
    n = 1_000_000 // len(one + other)
    assert scan(start + one * n + other * n) < 5


def test_mixed_tags_twice_as_long():
    dice = random.Random(3)
    pieces = [f"<{dice.choice(['', '', '/'])}{dice.choice(TAGS)}>{dice.choice(['', 'x ', 'y. '])}" for _ in range(120_000)]
    times = [min(scan("".join(pieces[:n])) for _ in range(3)) for n in (60_000, 120_000)]
    assert times[1] < 2.5 * times[0] + 0.1


def test_what_closes_what():
    f = html_main.Forest()
    f.add("<table><tr><td>a<p>b<tr><td>c<li>d<li>e</table><dl><dt>x<dd>y<dt>z</dl>")

    def above(i):
        while (i := f.parent[i]) >= 0:
            yield html_main.TAGS[f.tag[i]]

    cell = ["td", "tr", "table", "html"]
    assert [(t, list(above(i))) for i, t in enumerate(f.text) if t] == [
        ("a", cell), ("b", ["p", *cell]), ("c", cell), ("d", ["li", *cell]), ("e", ["li", *cell]), ("x", ["dt", "dl", "html"]), ("y", ["dd", "dl", "html"]), ("z", ["dt", "dl", "html"]),
    ]
