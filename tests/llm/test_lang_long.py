"""Languages whose documents are all long are learnt too, from the whole of them."""

import random

import numpy as np

from indexloom.llm import ppm_lang

SCHEMA = "doc_id long, text string, lang string"


def words(seed, syllables, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(syllables, k=3)) for _ in range(n))


def test_a_language_of_long_documents_only_is_learnt(spark):
    short = [(i, words(i, ["ba", "do", "ki"], 60), "xa") for i in range(20)]
    long = [(100 + i, words(i, ["zu", "ve", "po"], 4000), "xb") for i in range(9)]
    assert all(len(t) > ppm_lang.SAMPLE_CHARS for _, t, _ in long)
    rows = ppm_lang.identify(spark.createDataFrame(short + long, SCHEMA)).collect()
    assert all(r.lang_pred == ("xa" if r.doc_id < 100 else "xb") for r in rows)


def test_long_documents_are_learnt_from_start_to_end(spark):
    text = "a" * 30_000 + "b" * 30_000 + "c" * 30_000
    m = ppm_lang.learn(spark.createDataFrame([(i, text, "xx") for i in range(4)], SCHEMA), sample_chars=800)
    assert set(m.trees[0].contexts[0].tolist()) == {97, 98, 99}
    rows = spark.createDataFrame([(1, "é" * 10 + "x" * 80 + "é" * 10, "xx")], SCHEMA)
    assert rows.select(ppm_lang._windows(80).alias("w")).first().w == ["é" * 10] + ["x" * 10] * 6 + ["é" * 10]
    assert rows.select(ppm_lang._windows(100).alias("w")).first().w == [rows.first().text]


def test_the_sample_is_bounded(spark):
    rows = spark.createDataFrame([(i, words(i, ["zu", "ve"], 200), "xx") for i in range(40)], SCHEMA)
    sizes = [len(t) for r in rows.select(ppm_lang._windows(80).alias("w")).collect() for t in r.w]
    assert sizes == [10] * (8 * 40) and np.sum(sizes) <= 80 * 40


def test_a_hundred_languages(spark):
    """Each has its own tree, whatever the others need: accuracy on held-out documents stays."""
    r = random.Random(4)
    letters = ["".join(r.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçåøß", 14)) for _ in range(100)]
    syllables = [[x + y for x in a[:9] for y in a[9:]] for a in letters]
    rows = [(100 * d + k, words(100 * d + k, r.sample(syllables[k], 30), 80), f"x{k:02d}") for k in range(100) for d in range(12)]
    got = ppm_lang.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    lang = {i: k for i, _, k in rows}
    held = [x for x in got if x.held_out]
    assert len(held) > 300 and np.mean([x.lang_pred == lang[x.doc_id] for x in held]) > 0.97


def test_one_id_may_hold_all_rows(spark):
    rows = spark.createDataFrame([(7, words(i % 3, ["zu", "ve"], 20), "xx") for i in range(300)], SCHEMA)
    from indexloom.llm import textops

    assert textops.bounded_sample(rows, "lang", ["doc_id", "text"], 20).count() <= 40
