"""Documents of languages that the fixed tables don't hold, of rare languages and of none."""

import random

import cases
import numpy as np
import pytest

from indexloom.llm import quality_rules


def prose(seed, letters, words):
    r = random.Random(seed)
    return " ".join("".join(r.choices(letters, k=r.randint(5, 12))) for _ in range(words)).capitalize() + "."


GREEK = "αβγδεζηθικλμνξοπρστυφχψω"


@pytest.mark.parametrize(("lang", "docs", "words"), [("el", 40, 40), ("el", 3, 200), (None, 3, 200), (None, 40, 40)])
def test_clean_documents_of_other_scripts_stay(spark, lang, docs, words):
    rows = [(-1 - i, prose(i, GREEK, words), lang) for i in range(docs)]
    both = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(cases.sample(spark).select("doc_id", "text", "lang"))
    got = [r for r in quality_rules.judge(both).where("doc_id < 0").collect()]
    assert len(got) == docs and not any(r.base_failed for r in got) and all(r.kept for r in got)
    assert quality_rules.keep_good(both).where("doc_id < 0").count() == docs


def test_characters_and_words_have_references_of_their_own(spark):
    rows = [(i, prose(i, GREEK, 40), "el") for i in range(6)] + [(100 + i, prose(i, "ab", 70), "xx") for i in range(4)]
    refs = quality_rules.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert refs.shares["el"][0] is not None and refs.shares["el"][1] is None
    assert refs.shares["xx"] == (None, None) and not refs.limits


def test_junk_of_a_language_with_a_reference_goes(spark):
    junk = [(-1 - i, prose(i, "#*$%&|<>", 60), "el") for i in range(3)]
    rows = junk + [(1000 + i, prose(i, GREEK, 40), "el") for i in range(40)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.kept == (r.doc_id > 0) for r in got)


def prose_of(seed, common, letters, words):
    """Half of the words are the language's common ones."""
    r = random.Random(seed)
    return " ".join(r.choice(common) if r.random() < 0.5 else "".join(r.choices(letters, k=r.randint(3, 9))) for _ in range(words))


def test_words_alone_reject_junk_of_the_same_letters(spark):
    """The junk has the letters of its language, but none of its common words."""
    letters, common = "abcdefghijklmnop", ["abe", "dof", "gin", "hal", "mok", "pol", "jin", "kab", "ome", "fen"]
    rows = [(i, prose_of(i, common, letters, 200 + 9 * (i % 20)), "zz") for i in range(120)]
    rows += [(-1 - i, prose_of(i, ["".join(random.Random(7 * i + k).choices(letters, k=3)) for k in range(60)], letters, 250), "zz") for i in range(12)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    refs = quality_rules.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {w.decode() for w in refs.common["zz"][:10]} == set(common)
    clean = [r for r in got if r.doc_id >= 0 and not r.base_failed]
    junk = [r for r in got if r.doc_id < 0 and not r.base_failed]
    assert len(junk) == 12 and all(r.kept for r in clean) and not any(r.kept for r in junk)
    char_limit = refs.limit("zz", 0, np.array([1500] * len(junk)))
    assert np.mean([r.char_distance for r in junk] <= char_limit) > 0.8  # it is the words that tell


def test_a_wrong_label_is_no_fault(spark):
    greek = [(i, prose(i, GREEK, 60), "el") for i in range(40)]
    latin = [(100 + i, prose(i, "abcdefghij", 60), "la") for i in range(40)]
    wrong = [(-1, prose(999, GREEK, 60), "la")]
    got = quality_rules.judge(spark.createDataFrame(greek + latin + wrong, "doc_id long, text string, lang string")).collect()
    assert all(r.kept for r in got)


def brute_kept(rows):
    """Verdicts by the definitions, document by document, in plain Python."""
    import re
    from collections import Counter
    from math import floor, log, log2, sqrt

    import test_quality

    q = quality_rules
    word_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    kind_of = lambda c: int(q._CLASS[c.encode()[0]])
    docs = [(t or "", lang, word_of(t)) for _, t, lang in rows]
    hold: dict = {}
    for _, lang, ws in docs:
        hold.setdefault(lang, Counter()).update({w for w in ws if len(w.encode()) <= q.MAX_WORD_BYTES})
    common = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: q.TOP_WORDS]] for k, c in hold.items() if k is not None}

    def counts(text, ws, lang, kind):
        if kind == 0:
            n = Counter(map(kind_of, text))
            return [n[k] for k in range(q.CLASSES)]
        n = Counter(ws)
        known = [n[w] for w in common.get(lang, [])]
        return [*known, len(ws) - sum(known)]

    size = lambda text, ws, kind: len(text) if kind == 0 else len(ws)
    shares: dict = {}
    for text, lang, ws in docs:
        for kind in range(2):
            if lang is not None and (n := size(text, ws, kind)) >= q.LEAST[kind]:
                shares.setdefault((lang, kind), []).append([min(int(sqrt(c / n) * q.SHARE_BINS), q.SHARE_BINS - 1) for c in counts(text, ws, lang, kind)])
    value = lambda b: 0.0 if b == 0 else ((b + 0.5) / q.SHARE_BINS) ** 2
    refs = {}
    for (lang, kind), all_ in shares.items():
        if len(all_) >= q.MIN_REFERENCE_DOCS:
            ref = []
            for column in zip(*all_, strict=True):
                x = sorted(column)
                if kind == 0:
                    ref.append(value(next(b for i, b in enumerate(x) if i + 1 >= len(x) / 2)))
                else:
                    low, high = 0.05 * len(x), 0.95 * len(x)
                    mass = [min(max(i + 1, low), high) - min(max(i, low), high) for i in range(len(x))]
                    ref.append(sum(m * value(b) for m, b in zip(mass, x, strict=True)) / sum(mass))
            refs[lang, kind] = ref

    def distance(text, ws, lang, kind):
        if (lang, kind) not in refs or size(text, ws, kind) < q.LEAST[kind]:
            return None
        pick = q.COMPARED if kind == 0 else range(len(refs[lang, kind]))
        p, r = ([x[i] for i in pick] for x in (counts(text, ws, lang, kind), refs[lang, kind]))
        p, r = [x / sum(p) for x in p], [x / sum(r) for x in r]
        kl = lambda a: sum(x * log2(2 * x / (y + z)) for x, y, z in zip(a, p, r, strict=True) if x > 0)
        return sqrt(max((kl(p) + kl(r)) / 2, 0))

    seen: dict = {}
    for text, lang, ws in docs:
        for kind in range(2):
            if (d := distance(text, ws, lang, kind)) is not None:
                seen.setdefault((lang, kind, floor(log2(size(text, ws, kind)))), []).append(min(int(d * q.DISTANCE_BINS), q.DISTANCE_BINS - 1))

    def fit(text, ws, lang, kind):
        d, n = distance(text, ws, lang, kind), size(text, ws, kind)
        for length in range(floor(log2(max(n, 1))), -1, -1):
            if d is not None and len(x := seen.get((lang, kind, length), [])) >= q.MIN_LIMIT_DOCS:
                low, middle = np.quantile(x, [0.25, 0.5])
                return bool(d <= (middle + 0.5) / q.DISTANCE_BINS + q.SPREAD * max((middle - low) / q.DISTANCE_BINS, 1 / sqrt(16 * log(2) * n)))
        return None

    out = []
    for text, lang, ws in docs:
        own = [fit(text, ws, lang, kind) is not False for kind in range(2)]
        good = all(own) or any(all(own[k] or fit(text, ws, other, k) is True for k in range(2)) for other in common)
        out.append(good and not test_quality.brute(text)[5])
    return out


def test_op7_verdicts_equal_brute_force(spark):
    docs = cases.sample(spark, "sf0.001").select("doc_id", "text", "lang").unionByName(cases.documents(spark).select("doc_id", "text", "lang"))
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(zip([r[0] for r in rows], brute_kept(rows), strict=True), key=str)
    assert sorted(((r.doc_id, r.kept) for r in quality_rules.judge(docs).collect()), key=str) == want
    assert 10 < sum(not k for _, k in want) < len(want) / 2
