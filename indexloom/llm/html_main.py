"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded hierarchically.

A forgiving parser turns a page into a tree of elements and text runs. Every node gets features: its
tag, depth, tokens of its class, id and role, densities of text, links and marks in its subtree, and
its place among its siblings. Gradient-boosted trees, trained here on pages that a seeded generator
writes with known main text, give each node the probability that its subtree holds main text. The
decoder then picks, over the whole tree at once, the most probable assignment in which no dropped
node has a kept descendant; the text runs kept are the result.

Character references are decoded, white space within a block becomes one space, blocks are joined
by one space. Null and empty pages give an empty text, as do pages without a kept run. Repeated
pages give repeated results; ties between keeping and dropping a node keep it. Unclosed, stray and
unknown tags are read as browsers mostly do; text outside all tags is a text run of the page. Only
scripts, styles, titles, text areas, selections and templates never count; all else, formulas,
drawings and what stands for browsers without scripts or frames included, is for the trees to judge.
Formulas, drawings and selections end where a block begins that can't stand in them. Pages are read
whole, however deep their nesting, by a scanner that only moves forward: time and memory follow the
page's length. Extra columns are left out, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from indexloom.llm import textops

TRAIN_PAGES = 500
TREES = 50
DEPTH = 5
RATE = 0.25
BINS = 48
SCORED = 50_000  # nodes whose features are in memory at once

#: HTML's own sets of elements. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())  # their contents are no markup
DROPPED = frozenset("template select".split())
SEALED = frozenset("svg math select".split())  # end where a block begins, unless it stands in one of these:
HOLDS_BLOCKS = frozenset("template foreignobject annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "body": ("html",)}
LIMITS_P = ("td", "th", "table", "button", "article", "section", "div", "li", "blockquote")
TAGS = "#text a article aside b blockquote body button code dd div dl dt em fieldset figcaption figure footer form h1 h2 h3 h4 header html i label li main nav ol p pre section span strong table tbody td th tr ul head".split()

#: Groups of words in class, id and role that say what an element is for. Fixed values.
GROUPS = [
    "article content main post entry story text body prose",
    "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs links",
    "header masthead top topbar logo branding",
    "footer bottom copyright legal colophon",
    "sidebar side aside widget rail secondary column",
    "ad ads advert advertisement adverts banner promo promoted sponsor sponsored sponsors",
    "cookie cookies consent notice alert gdpr popup modal newsletter subscribe overlay warning",
    "form login search signup contact register",
    "comment comments reply replies respond discussion disqus thread",
    "share social related recommended recommendations more tags meta byline author popular",
]
_GROUP_SETS = [frozenset(g.split()) for g in GROUPS]
_TAG_ID = {t: i for i, t in enumerate(TAGS)}
_OTHER = len(TAGS)

_HOLD_P = tuple({*HOLDS_BLOCKS, *CLOSES_P} - {*SEALED})

_OPEN = re.compile(r"<(?:!--|[!?/]|[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_STOP = re.compile(r">|=\s*[\"']")  # what ends a tag, and where a quoted value begins
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def _tag_end(source: str, at: int) -> int:
    """The place of the > that ends a tag, quoted values skipped; -1 if none does. A quote that nothing closes is no quote."""
    while m := _STOP.search(source, at):
        if m[0] == ">":
            return m.start()
        close = source.find(m[0][-1], m.end())
        at = m.end() if close < 0 else close + 1
    return -1


def attribute_groups(attrs: str) -> int:
    return _groups(attrs) if len(attrs) < 500 else _groups.__wrapped__(attrs)  # long ones aren't remembered


@lru_cache(20_000)
def _groups(attrs: str) -> int:
    words = set()
    for value in _ATTR.findall(attrs):
        words.update(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return sum(1 << k for k, g in enumerate(_GROUP_SETS) if words & g)


class Forest:
    """Nodes of many pages in document order, as columns."""

    def __init__(self):
        self.page, self.parent, self.tag, self.groups, self.depth, self.end = [], [], [], [], [], []
        self.chars, self.stops, self.link, self.block = [], [], [], []
        self.text: list[str | None] = []
        self.pages = 0

    def add(self, source: str) -> None:
        page = self.pages
        self.pages += 1
        stack: list[tuple[str, int]] = []
        opened: dict[str, int] = {}  # how many elements of each tag are open
        places: dict[str, list[int]] = {}  # and where they stand in the stack
        block = 0

        def node(tag: str, attrs: str, text: str | None) -> int:
            self.page.append(page)
            self.parent.append(stack[-1][1] if stack else -1)
            self.tag.append(_TAG_ID.get(tag, _OTHER))
            self.groups.append(attribute_groups(attrs) if attrs else 0)
            self.depth.append(len(stack))
            self.end.append(len(self.end) + 1)
            self.text.append(text)
            self.link.append(opened.get("a", 0) > 0)
            self.block.append(block)
            self.chars.append(len(text) if text else 0)
            self.stops.append(text.count(".") + text.count(",") if text else 0)
            return len(self.tag) - 1

        def push(tag: str, n: int) -> None:
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, n))
            opened[tag] = opened.get(tag, 0) + 1

        def close(to: int) -> None:
            while len(stack) > to:
                t, n = stack.pop()
                opened[t] -= 1
                places[t].pop()
                if n >= 0:
                    self.end[n] = len(self.tag)

        def is_open(*tags: str) -> int:
            return sum(opened.get(t, 0) for t in tags)

        def innermost(tags) -> int:
            """Where the innermost open element of these tags stands; -1 if none is open."""
            return max((places[t][-1] for t in tags if opened.get(t)), default=-1)

        push("#page", node("html", "", None))
        at = 0
        while at < len(source):
            m = _OPEN.search(source, at)
            run = source[at : m.start() if m else len(source)]
            if run and not is_open(*DROPPED):
                node("#text", "", " " if run.isspace() else html.unescape(run))
            if not m:
                break
            start = m[0]
            if start == "<!--":
                at = source.find("-->", m.start() + 2) + 3
                if at < 3:
                    break
                continue
            name = _NAME.match(source, m.start() + 2) if start == "</" else _NAME.match(source, m.start() + 1) if start[1].isalpha() else None
            if name is None or not name[0][0].isalpha():  # a declaration, an instruction or a stray </
                at = source.find(">", m.end()) + 1
                if not at:
                    break
                continue
            tag = name[0].lower()
            foreign = is_open("svg", "math") > 0
            if tag not in INLINE and not foreign:
                block += 1
            if start == "</":
                at = source.find(">", name.end()) + 1
                if opened.get(tag, 0) and tag != "#page":
                    close(places[tag][-1])
                if not at:
                    break
                continue
            end = _tag_end(source, name.end())
            if end < 0:
                break
            attrs, at = source[name.end() : end], end + 1
            if tag in CLOSES_P and is_open(*SEALED):
                sealed = innermost(SEALED)
                if sealed > innermost(_HOLD_P):
                    close(sealed)
                foreign = is_open("svg", "math") > 0
            if tag in VOID:
                continue
            itself = attrs.endswith("/") and (foreign or tag in ("svg", "math"))  # HTML's own elements don't close themselves
            if tag in RAW:
                if not itself:
                    last = _RAW_END[tag].search(source, at)
                    at = source.find(">", last.end()) + 1 if last else 0
                    if not at:
                        break
                continue
            closes, limit = CLOSES.get(tag, ()), STOPS.get(tag, ())
            if tag in CLOSES_P:
                closes, limit = (*closes, "p"), (*limit, *LIMITS_P)
            while is_open(*closes):
                k = innermost(closes)
                if k < innermost(t for t in (*limit, *DROPPED) if t not in closes):
                    break
                close(k)
                if tag != "tr":
                    break
            if is_open(*DROPPED) or tag in DROPPED:
                if not itself:
                    push(tag, -1)
                continue
            n = node(tag, attrs, None)
            if not itself:
                push(tag, n)
        close(0)


FEATURES = 29 + 3 * len(GROUPS)


def _down(values: np.ndarray, parent: np.ndarray, depth: int, join) -> np.ndarray:
    """Each node's value joined with all its ancestors', in steps that double the way up; join(x, x) is x."""
    up = np.where(parent < 0, np.arange(len(parent)), parent)
    for _ in range(int(depth).bit_length()):
        values = join(values, values[up])
        up = up[up]
    return values


class Features:
    """The features of a forest's nodes; `rows` gives some of them as a matrix."""

    def __init__(self, f: Forest):
        n = len(f.tag)
        tag, parent, depth, end = (np.array(x, dtype=np.int64) for x in (f.tag, f.parent, f.depth, f.end))
        page, groups, chars, stops = (np.array(x, dtype=np.int64) for x in (f.page, f.groups, f.chars, f.stops))
        link = np.array(f.link, dtype=bool)
        index = np.arange(n)
        total = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[index]  # noqa: E731  over each subtree
        text = tag == 0
        up = np.maximum(parent, 0)
        n_chars, n_text, n_nodes = total(chars), total(text), end - index
        n_link = total(np.where(link, chars, 0))
        n_stops = total(stops)
        n_p = total(tag == _TAG_ID["p"])
        n_li = total(tag == _TAG_ID["li"])
        n_a = total(tag == _TAG_ID["a"])
        children = np.bincount(up[parent >= 0], minlength=n)
        order = np.argsort(parent, kind="stable")
        first = np.searchsorted(parent[order], parent)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = index
        place = rank - first
        roots = np.flatnonzero(parent < 0)
        root = roots[page]
        page_chars, page_nodes = np.maximum(n_chars[root], 1), np.maximum(n_nodes[root], 1)
        before = np.concatenate([[0], np.cumsum(chars)])[index] - np.concatenate([[0], np.cumsum(chars)])[root]
        special = np.zeros(_OTHER + 1, dtype=np.int64)
        for k, t in enumerate(("nav", "header", "footer", "aside", "form", "article", "main", "li", "ul", "a", "h1", "p", "table", "figure", "section", "button")):
            special[_TAG_ID[t]] = 1 << k
        deepest = depth.max(initial=0)
        above_tag = _down(special[tag], parent, deepest, np.bitwise_or)
        self.groups = groups, groups[up], _down(groups, parent, deepest, np.bitwise_or)
        sib_chars = n_chars[up] - n_chars
        ratio = lambda a, b: a / np.maximum(b, 1)
        columns = [
            tag, depth, np.log1p(n_chars), ratio(n_chars, page_chars), ratio(n_chars, n_nodes), ratio(n_link, n_chars), ratio(n_stops * 20, n_chars),
            np.log1p(n_nodes), ratio(n_nodes, page_nodes), n_p, n_li, n_a, ratio(n_chars, n_text), children, place, ratio(place, children[up]),
            tag[up], np.log1p(n_chars[up]), ratio(n_chars, n_chars[up]), ratio(n_link[up], n_chars[up]), ratio(sib_chars, page_chars),
            ratio(before, page_chars), above_tag & 0x1F, (above_tag >> 5) & 0x3, (above_tag >> 7) & 0xF, (above_tag >> 11) & 0x1F, n_p[up], children[up], n_stops,
        ]
        self.columns = [c.astype(np.float32) for c in columns]
        self.n = n

    def rows(self, at) -> np.ndarray:
        bits = [(g[at] >> k) & 1 for k in range(len(GROUPS)) for g in self.groups]
        return np.stack([c[at] for c in self.columns] + bits, axis=1).astype(np.float32)


class Boosted:
    """Gradient-boosted trees for a log-odds score, on binned features; trees are complete and of equal depth."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        b = self.binned(x)
        n, m = b.shape
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score = np.full(n, self.bias)
        self.feature, self.cut, self.leaf = [], [], []
        flat = b.astype(np.int64) + np.arange(m) * BINS
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            where = np.zeros(n, dtype=np.int64)
            features, cuts = [], []
            for level in range(depth):
                size = 1 << level
                slot = (where[:, None] * (m * BINS) + flat).reshape(-1)
                shape = (size, m, BINS)
                hg = np.bincount(slot, weights=np.repeat(g, m), minlength=size * m * BINS).reshape(shape).cumsum(axis=2)
                hh = np.bincount(slot, weights=np.repeat(h, m), minlength=size * m * BINS).reshape(shape).cumsum(axis=2)
                tg, th = hg[:, :, -1:], hh[:, :, -1:]
                gain = hg**2 / (hh + 1) + (tg - hg) ** 2 / (th - hh + 1) - tg**2 / (th + 1)
                gain[(hh < 2) | (th - hh < 2)] = -1
                best = gain.reshape(size, -1).argmax(axis=1)
                feature, cut = best // BINS, best % BINS
                cut = np.where(gain.reshape(size, -1)[np.arange(size), best] > 0, cut, BINS)
                features.append(feature)
                cuts.append(cut)
                where = where * 2 + (b[np.arange(n), feature[where]] > cut[where])
            tg, th = np.bincount(where, weights=g, minlength=1 << depth), np.bincount(where, weights=h, minlength=1 << depth)
            leaf = rate * tg / (th + 1)
            score += leaf[where]
            self.feature.append(np.concatenate(features))
            self.cut.append(np.concatenate(cuts))
            self.leaf.append(leaf)
        self.depth = depth
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        flat, base = b.reshape(-1), np.arange(len(b)) * b.shape[1]
        out = np.full(len(b), self.bias)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            where = np.zeros(len(b), dtype=np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + where
                where = 2 * where + (flat[base + feature[at]] > cut[at])
            out += leaf[where]
        return out


def decode(f: Forest, score: np.ndarray) -> np.ndarray:
    """Most probable keep/drop labels in which a dropped node has no kept descendant. score: log-odds of keeping."""
    n = len(score)
    drop = -np.logaddexp(0, score)
    c = np.concatenate([[0], np.cumsum(drop)])
    all_dropped = c[np.array(f.end, dtype=np.int64)] - c[:n]
    best, without = (-np.logaddexp(0, -score)).tolist(), all_dropped.tolist()  # best: of the subtree, if the node is kept
    for i in range(n - 1, -1, -1):  # children come after their parents
        if (p := f.parent[i]) >= 0:
            best[p] += max(best[i], without[i])
    return _down(np.array(best) >= all_dropped, np.array(f.parent, dtype=np.int64), max(f.depth, default=0), np.logical_and)


# --- training pages -------------------------------------------------------------------------------

_MARK = "\ue000"  # stands before each run of main text that the generator writes


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = [a + b for a in ("", "b", "ch", "d", "f", "l", "m", "n", "p", "r", "s", "t", "th", "v", "é", "ü") for b in ("a", "e", "i", "o", "u", "an", "er", "on", "ing")]
        self.named = self.r.random() < 0.75  # does this site name its elements by class and id?

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(self.syllables, k=self.r.randint(1, 3))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        mark = self.r.choice(["", "", "", "", "!!", "&amp;&amp;", " |", "%%"])
        return " ".join(self.words(1, 18).replace(" ", mark + " ").capitalize() + self.r.choice(".....,!") for _ in range(self.r.randint(low, high)))

    def attr(self, *names: str) -> str:
        if not self.named or not names:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}{self.r.choice(["", "", "-" + self.words(1, 1)])}"'

    def links(self, low: int, high: int) -> str:
        return "".join(self.r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> "]).format(self.words(1, 4)) for _ in range(self.r.randint(low, high)))

    def element(self, tags: list[str], names: tuple[str, ...], inner: str) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.attr(*names)}>{inner}</{tag}>"

    def nav(self) -> str:
        inner = self.links(2, 9)
        return self.element(["nav", "div", "ul"], ("nav", "menu", "breadcrumb", "navbar"), self.r.choice(["<ul>{}</ul>", "{}"]).format(inner)) if self.named else self.element(["nav", "ul"], (), inner)

    def header(self) -> str:
        return self.element(["header", "div"] if self.named else ["header"], ("header", "masthead", "topbar"), self.r.choice(["<h1>{}</h1>", "<a href='/'>{}</a>", "{}", "<p>{}</p>"]).format(self.words(1, 6)) + self.r.choice(["", self.nav(), self.drawing()]))

    def drawing(self) -> str:
        return self.r.choice(["<svg class=icon><path d='M0'/></svg>", f"<svg><title>{self.words(1, 2)}</title><path/></svg>", f"<svg><text>{self.words(1, 2)}</text></svg>"])

    def no_script(self) -> str:
        return f"<noscript>{self.r.choice(['{}', '<p>{}</p>', '<div>{}</div>', '<iframe src=x>{}</iframe>']).format(self.sentences(1, 2))}</noscript>"

    def footer(self) -> str:
        return self.element(["footer", "div"] if self.named else ["footer"], ("footer", "copyright", "legal", "colophon"), f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 3)}" + self.r.choice(["", self.links(1, 5), f"<p>{self.sentences(1, 2)}</p>"]))

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([f"<ul>{self.links(2, 8)}</ul>", f"<p>{self.sentences(1, 4)}</p>"])
        return self.element(["aside", "div"] if self.named else ["aside"], ("sidebar", "widget", "related", "rail"), inner)

    def ad(self) -> str:
        return self.element(["div", "aside", "section", "p"], ("ad", "advert", "sponsored", "banner", "promo"), self.r.choice(["{}", "<p>{}</p>", "<a href='/b'>{}</a>"]).format(self.sentences(1, 3))) if self.named else self.element(["aside"], (), self.sentences(1, 2))

    def notice(self) -> str:
        return self.element(["div", "section", "p"], ("cookie", "consent", "notice", "newsletter", "alert"), self.r.choice(["{}", "<p>{}</p>"]).format(self.sentences(1, 4)) + self.r.choice(["", "<button>Ok</button>"])) if self.named else f"<form><p>{self.sentences(1, 2)}</p><button>Ok</button></form>"

    def form(self) -> str:
        return self.element(["form"], ("search", "login", "contact", "subscribe"), "".join(f"<label>{self.words(1, 4)}</label><input name=q>" for _ in range(self.r.randint(1, 4))) + f"<p>{self.sentences(0, 2)}</p><button>{self.words(1, 2)}</button>")

    def comments(self) -> str:
        one = lambda: self.element(["div", "li", "article"], ("comment", "reply"), f"<b>{self.words(1, 2)}</b><p>{self.sentences(1, 5)}</p>")
        return self.element(["div", "section"], ("comments", "respond", "discussion", "thread"), f"<h2>{self.words(1, 3)}</h2>" + "".join(one() for _ in range(self.r.randint(1, 6)))) if self.named else ""

    def main_run(self, text: str) -> str:
        return _MARK + text

    def paragraph(self) -> str:
        t = self.sentences(1, 7)
        kind = self.r.random()
        if kind < 0.5:
            body = self.main_run(t)
        else:
            cut = self.words(1, 3)
            tag = self.r.choice(["b", "em", "a", "i", "code", "span", "strong"])
            inner = f"<{tag}>{self.main_run(cut)}</{tag}>" if self.r.random() < 0.85 else self.r.choice([f"<math><mi>{self.main_run(cut)}</mi></math>", f"<svg><text>{self.main_run(cut)}</text></svg>", f"<noscript>{self.main_run(cut)}</noscript>"])
            body = f"{self.main_run(self.sentences(0, 3))} {inner} {self.main_run(t)}"
        return self.r.choice([f"<p>{body}</p>"] * 5 + [f"<p>{body}", f"<p><b>{body}<br>", f"<div>{body}</div>"])

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.72:
            return self.paragraph()
        if kind < 0.82:
            return f"<h{(k := self.r.choice('234'))}>{self.main_run(self.words(1, 8))}</h{k}>"
        if kind < 0.9:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.main_run(self.words(2, 20))}</li>" for _ in range(self.r.randint(1, 7))) + f"</{tag}>"
        if kind < 0.94:
            return f"<blockquote>{self.paragraph()}</blockquote>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{self.main_run(self.words(2, 15))}</figcaption></figure>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{self.main_run(self.words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>"

    def article(self) -> str:
        head = self.r.choice(["h1", "h1", "h1", "h2"])
        inner = [self.r.choice([f"<{head}>{self.main_run(self.words(1, 10))}</{head}>"] * 5 + [f"<header><{head}>{self.main_run(self.words(1, 10))}</{head}></header>", ""])]
        inner += [self.block() for _ in range(self.r.choice([0, 1, 2, 3, 5, 8, 13, 20]))] or [self.paragraph()]
        for extra in (self.ad, self.notice, self.form, self.side):
            if self.r.random() < 0.1:
                inner.insert(self.r.randint(1, len(inner)), extra())
        body = "".join(inner)
        if self.r.random() < 0.15:
            body += self.comments()
        return self.element(["article", "article", "article", "main", "div", "section"] if self.named else ["article", "main"], ("article", "content", "post", "entry", "story"), body)

    def page(self) -> str:
        maybe = lambda p, f: f() if self.r.random() < p else ""
        before = [maybe(0.6, self.header), maybe(0.7, self.nav), maybe(0.5, self.ad), maybe(0.3, self.notice), maybe(0.2, self.side), maybe(0.15, self.form), maybe(0.1, self.no_script), maybe(0.1, self.drawing)]
        after = [maybe(0.3, self.comments), maybe(0.3, self.side), maybe(0.2, self.ad), maybe(0.15, self.form), maybe(0.2, self.notice), maybe(0.8, self.footer)]
        self.r.shuffle(before)
        middle = "".join(before) + self.article() + "".join(after)
        if self.r.random() < 0.3:
            middle = self.element(["div", "main"], ("wrapper", "container", "page"), middle)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title><style>p{{}}</style></head><body><script>x('</p>')</script>{middle}" + self.r.choice(["</body></html>", ""])


@lru_cache(1)
def trained(pages: int = TRAIN_PAGES, seed: int = 7) -> Boosted:
    """Trees fitted to `pages` generated pages; a node is positive if its subtree holds main text."""
    f = Forest()
    for k in range(pages):
        f.add(_Writer(seed * 100_003 + k).page())
    main = np.array([bool(t) and _MARK in t for t in f.text])
    f.text = [t.replace(_MARK, "") if t else t for t in f.text]
    f.chars = [len(t) if t else 0 for t in f.text]
    c = np.concatenate([[0], np.cumsum(main)])
    y = (c[np.array(f.end)] > c[: len(main)]).astype(np.float64)
    blank = np.array([t is not None and not t.strip() for t in f.text])
    return Boosted().fit(Features(f).rows(~blank), y[~blank])


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    if not sources:
        return []
    f = Forest()
    for s in sources:
        f.add(s or "")
    x = Features(f)
    kept = decode(f, np.concatenate([model.score(x.rows(slice(a, a + SCORED))) for a in range(0, x.n, SCORED)]))
    # blank runs go with what stands around them: they only part words
    out: list[list[str]] = [[] for _ in sources]
    last = [-1] * len(sources)
    is_text = np.flatnonzero(np.array([t is not None for t in f.text], dtype=bool)) if f.text else []
    for k in is_text:
        t, p = f.text[k], f.page[k]
        if kept[k] or t == " ":
            if f.block[k] != last[p]:
                out[p].append(" ")
            last[p] = f.block[k]
            out[p].append(t if kept[k] else " ")
    return [" ".join("".join(parts).split()) for parts in out]


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "html", 1_000_000):
                texts = main_texts(textops.text_column(part, "html").to_pylist(), sent.value)
                yield textops.batch_of(_RESULT, part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), texts, [len(t) for t in texts])

    return textops.narrow(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
