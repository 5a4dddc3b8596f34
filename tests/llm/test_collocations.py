"""Collocations against counts made in plain Python."""

import random
import re
from collections import Counter

import cases
import pyarrow as pa
import pytest

from indexloom.llm import collocations


def plain_pieces(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for piece in re.split("[.,;:!?\x0a-\x0d]", low):
        if words := [w for w in re.split("[\x20\x09]+", piece) if w]:
            yield words


def counted(rows, longest=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in plain_pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, longest=3, least=10, top=2000):
    f, n = counted(rows, longest)
    cand = {key: a for key, a in f.items() if len(key) > 2 and a >= least}
    dead = set()
    for (lang, *w), b in cand.items():
        for k in range(2, len(w)):
            dead |= {p for i in range(len(w) - k + 1) if 100 * b >= 50 * cand[p := (lang, *w[i : i + k])]}
    found = {}
    for key, a in cand.items():
        if key not in dead:
            lang, *w = key
            score, _, l, r = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, every in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(every)[:top], 1)}


def got(docs, **how):
    counts = collocations.phrase_counts(docs, how.get("longest", 3), how.get("least", 10)).persist()
    rows = [tuple(r) for r in collocations.collocations(counts, how.get("longest", 3), how.get("top", 2000)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("make", [cases.documents, cases.sample])
def test_equals_brute_force(spark, make):
    docs = make(spark)
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert got(docs) == brute(rows)
    assert {tuple(r) for r in collocations.mine(docs).collect()} == brute(rows)


def noise(seed, n=60):
    dice = random.Random(seed)
    letters = ["a", "b", "A", "é", "日本", " ", "x"]
    return [(dice.choice(["en", "de", None, "und", ""]), "".join(dice.choice(letters) + dice.choice(["", " ", "  ", "\t", ", ", ".", "\r\n", "\x0b", "\x1c", " "]) for _ in range(200))) for _ in range(n)]


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (2, 2, 7), (5, 3, 40)])
def test_noise_and_other_parameters(spark, longest, least, top):
    rows = noise(longest)
    docs = spark.createDataFrame([(k, *r, "clash", 1) for k, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(7)
    want = brute(rows, longest, least, top)
    assert want and got(docs, longest=longest, least=least, top=top) == want


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, 2 * big), ("en", "", 0, 9 * big)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, n long")
    assert [tuple(r) for r in collocations.collocations(counts).collect()] == [("en", 1, "a b", big - 1, big, 2 * big, 9 * big, 1_000_000 * (big - 1) ** 2 // (2 * big * big))]


def test_pieces_keep_their_words():
    texts = [None, "", " \t", "A  b\tC.d,,e ", "ÉTÉ!\x0bx\x1cy", ". , ;", "z" * 70_000 + " end", "last"]
    text, piece = collocations.pieces_of(pa.array([t or "" for t in texts], pa.large_string()))
    want = [(i, " ".join(w)) for i, t in enumerate(texts) for w in plain_pieces(t)]
    assert list(zip(text.tolist(), piece.to_pylist(), strict=True)) == want


def test_repeats_long_texts_and_empty_table(spark):
    docs = spark.createDataFrame([("en", "so it goes. " * 30_000), *[("en", "so it goes")] * 500], "lang string, text string")
    assert got(docs) == {("en", 1, "so it goes", 30_500, 30_500, 30_500, 91_500, 1_000_000)}
    assert got(docs.limit(0)) == set()
    assert collocations.mine(cases.empty(spark)).count() == 0
