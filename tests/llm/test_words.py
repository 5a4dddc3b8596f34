"""Words, windows and shingles are told apart by their bytes, whatever their pattern of letters."""

import cases
import numpy as np
import pyarrow as pa
import test_decontam
import test_jaccard
import test_quality

from indexloom.llm import decontam, jaccard_join, quality_rules, textops


def thue_morse(n, letters="ab"):
    """Polynomial hashes modulo a power of two take such words and their complements for equal."""
    bits = np.array([0])
    while len(bits) < n:
        bits = np.concatenate([bits, 1 - bits])
    return "".join(letters[b] for b in bits)


A, B = thue_morse(2048), thue_morse(2048, "ba")


def test_codes_are_exact():
    texts = [f"{A} {B} x {A}", "", "Y y ÿ Ÿ", B]
    w = textops.Words(*textops.utf8(pa.array(texts, type=pa.large_string())))
    assert w.id[0] == w.id[3] != w.id[1] and w.id[-1] == w.id[1] and w.hash[0] != w.hash[1]
    assert [x.decode() for x in w.distinct.take(pa.array(w.id)).to_pylist()] == [A, B, "x", A, "y", "y", "ÿ", "Ÿ", B]
    assert len({textops.Words(*textops.utf8(pa.array([t], type=pa.large_string()))).hash[0] for t in (A, B)}) == 2


def docs(spark):
    row = lambda w: " ".join(f"{w} one two three" for _ in range(3))
    texts = [row(A), row(B), " ".join([A] * 12), " ".join([B] * 12), " ".join([A, "c", "d", "e", "f", "g", "h", "i", B, "c", "d", "e", "f", "g", "h", "i"] + [f"w{i}" for i in range(20)])]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], cases.SCHEMA)


def test_op3_tells_such_words_apart(spark):
    bench = spark.createDataFrame([(1, " ".join(f"{A} one two three" for _ in range(3))), (2, " ".join([B] * 10))], "item_id long, text string")
    want = test_decontam.brute([(r.doc_id, r.text) for r in docs(spark).collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(tuple(r)[:6] for r in decontam.contamination(docs(spark), bench).collect()) == sorted(want)
    assert [w[2] for w in want] == [12, 0, 0, 12, 0]


def test_op6_tells_such_words_apart(spark):
    test_jaccard.check(spark, docs(spark))


def test_op7_tells_such_words_apart(spark):
    got = [tuple(r)[:7] for r in quality_rules.judge(docs(spark)).collect()]
    assert sorted(got) == sorted((r.doc_id, *test_quality.brute(r.text)) for r in docs(spark).collect())
    assert [r[5] for r in sorted(got)] == [12, 12, 12, 12, 0]
