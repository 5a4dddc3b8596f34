"""Short notices and notices that repeat close together, against a search for their words."""

import random
import re
import time

import cases
import numpy as np
import pytest
import test_license

from indexloom.llm import license_scan

NOTICES = {n: t for n, t in license_scan.TEMPLATES.items() if len(t.split()) < 15 and (n.endswith("notice") or n.endswith("sentence"))}
LINES = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Licensed under CC BY-NC 4.0."]


def scans(spark, texts):
    rows = license_scan.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[(f.license, f.start, f.end) for f in r.finds] for r in sorted(rows, key=lambda r: r.doc_id)]


def brute(text, templates=NOTICES):
    found = [(n, m.start(), m.end()) for n, t in templates.items() for m in re.finditer(r"(?<![^\W_])" + r"[\W_]+".join(re.findall(r"\w+", t)) + r"(?![^\W_])", text or "", re.I)]
    return sorted(found, key=lambda f: f[1])


@pytest.mark.parametrize("gap", [0, 1, 2, 3, 5, 8, 12, 16, 30])
def test_adjacent_repeats_are_all_found(spark, gap):
    filler = " ".join(f"w{i}" for i in range(gap))
    texts = [f"before {t}. {filler}\n{t} {filler} {t}, after" for t in NOTICES.values()]
    assert scans(spark, texts) == [brute(t) for t in texts]


def test_mixed_notices_equal_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice([*NOTICES.values(), "some", "other", "words"]) for _ in range(r.randint(1, 12))) for _ in range(40)]
    assert scans(spark, texts) == [brute(t) for t in texts]


def test_a_short_notice_is_found_whatever_stands_beside_it(spark):
    texts = [f"{a} x{i} All rights reserved y{i} {a}" for i, a in enumerate(["", "one", "two words"] * 30)]
    assert scans(spark, texts) == [brute(t) for t in texts]


def test_long_texts_repeated_in_a_row(spark):
    mit = license_scan.TEMPLATES["MIT text"]
    (got,) = scans(spark, [f"{mit}\n{mit}\n{mit}"])
    assert got == [("MIT text", k * (len(mit) + 1), k * (len(mit) + 1) + len(mit) - 1) for k in range(3)]


def test_planted_lines_equal_brute_force(spark):
    docs = cases.sample(spark, "sf0.01")
    lines = dict(zip(LINES, LINES, strict=True))
    want = {r.doc_id: sorted(f[1:] for f in brute(r.text, lines)) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: sorted((f.start, f.end) for f in r.finds) for r in license_scan.find_licenses(docs).collect()}
    assert sum(map(len, want.values())) >= 46 and got == want


INDEX = license_scan.Index(license_scan.TEMPLATES)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 100, 1000])
def test_n_adjacent_notices_give_n_finds(n):
    text = "Released under the MIT License " * n
    finds = license_scan.scan(test_license.hashes(text), INDEX)
    assert [(INDEX.names[f[0]], f[3], f[4]) for f in finds] == [("MIT notice", 5 * k, 5 * k + 5) for k in range(n)]


def test_time_follows_the_number_of_notices():
    spent = []
    for n in (1000, 4000):
        words = test_license.hashes("some words between them. Released under the MIT License. " * n)
        began = time.process_time()
        assert len(license_scan.scan(words, INDEX)) == n
        spent.append(time.process_time() - began)
    assert spent[1] < 7 * spent[0]


def unbanded(template, text):
    """The best local alignment over all places, by the plain table: (score, matched words, start, end)."""
    n = len(text)
    score, matched, start = (np.zeros(n + 1, dtype=int) for _ in range(3))
    best = (0, 0, 0, 0)
    for word in template:
        s, m, b = np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=int)
        for j in range(1, n + 1):
            same = text[j - 1] == word
            options = [(score[j - 1] + (license_scan.MATCH if same else license_scan.MISMATCH), matched[j - 1] + same, b0 if (b0 := start[j - 1]) and score[j - 1] > 0 else j)]
            options += [(score[j] + license_scan.GAP, matched[j], start[j]), (s[j - 1] + license_scan.GAP, m[j - 1], b[j - 1])]
            s[j], m[j], b[j] = max(options, key=lambda o: o[0])
            if s[j] <= 0:
                s[j], m[j], b[j] = 0, 0, 0
            elif same and s[j] > best[0]:
                best = (s[j], m[j], b[j] - 1, j)
        score, matched, start = s, m, b
    return best


@pytest.mark.parametrize("name", ["Apache-2.0 header", "ISC text", "BSD-3-Clause clause", "LGPL header", "GPL header", "Zlib text"])
def test_altered_texts_equal_an_unbanded_alignment(name):
    r = random.Random(name)
    template = INDEX.words[INDEX.names.index(name)]
    for _ in range(4):
        words, k = [], 0
        for w in template.tolist():
            k += 1
            if r.random() < 0.04:
                continue
            if r.random() < 0.05:
                words.append(r.getrandbits(60))
            words.append(r.getrandbits(60) if r.random() < 0.03 else w)
        text = np.array([r.getrandbits(60) for _ in range(r.randint(0, 40))] + words + [r.getrandbits(60) for _ in range(r.randint(0, 40))], dtype=np.uint64)
        want = unbanded(template, text)
        got = [f for f in license_scan.scan(text, INDEX) if INDEX.names[f[0]] == name]
        if want[1] >= license_scan.MIN_COVERAGE * len(template):
            assert [(f[1], f[3], f[4]) for f in got] == [want[1:]] and abs(got[0][2] - want[1] / len(template)) < 1e-12
        else:
            assert got == []


def phrases(name, n, seed=5):
    """n words of a template's phrases of four words, in any order."""
    r = random.Random(seed)
    words = license_scan.TEMPLATES[name].split()
    parts = [words[i : i + 4] for i in range(0, len(words), 4)]
    return sum((r.choice(parts) for _ in range(n // 4)), [])


@pytest.mark.parametrize("words", [phrases("MIT text", 160_000), phrases("Zlib text", 160_000), "the software is".split() * 53_000, "rights reserved all".split() * 20_000])
def test_near_misses_take_little_time(words):
    hashes = test_license.hashes(" ".join(words))
    began = time.process_time()
    finds = license_scan.scan(hashes, INDEX)
    assert time.process_time() - began < 10
    assert {INDEX.names[f[0]] for f in finds} <= {"All rights reserved notice"}


def test_a_find_among_near_misses():
    before, notice, after = (test_license.hashes(x) for x in (" ".join(phrases("MIT text", 30_000)), license_scan.TEMPLATES["MIT text"], " ".join(phrases("MIT text", 30_000, 6))))
    finds = [f for f in license_scan.scan(np.concatenate([before, notice, after]), INDEX) if INDEX.names[f[0]] == "MIT text"]
    assert [f[1:] for f in finds] == [(len(notice), 1.0, len(before), len(before) + len(notice))]


@pytest.mark.parametrize("cells", [1, 1000, license_scan.STEPS])
def test_what_is_left_out_can_hold_no_find(monkeypatch, cells):
    """A diagonal that is left out has no alignment that reaches the coverage, however the table is divided."""
    monkeypatch.setattr(license_scan, "STEPS", cells)
    r = random.Random(7)
    for name in ("MIT notice", "ISC text", "GPL header"):
        template = INDEX.words[INDEX.names.index(name)]
        text = np.array([w if r.random() < 0.8 else r.getrandbits(60) for _ in range(3) for w in template.tolist() + template.tolist()[: r.randint(0, len(template))]], dtype=np.uint64)
        steps = np.arange(-len(template) // license_scan.BAND, len(text) // license_scan.BAND + 1)
        kept = license_scan.hopeful(template, text, steps)
        shift = steps * license_scan.BAND + license_scan.BAND // 2
        lo, hi = np.zeros(len(steps), np.int64), np.full(len(steps), len(text))
        matched = license_scan.align(template, text, lo, hi, shift, 2 * license_scan.BAND)[1]
        bound = license_scan.reach(template, text, lo, hi, shift, 2 * license_scan.BAND)
        assert (matched <= bound).all() and set(steps[matched >= license_scan.MIN_COVERAGE * len(template)]) <= set(kept)
