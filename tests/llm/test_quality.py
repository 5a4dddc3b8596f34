import re
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest

from indexloom.llm import knn_quality, ppm_lang, quality_rules, textops


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


@pytest.mark.parametrize("make", [cases.documents, cases.sample, cases.empty])
def test_op7_base_equals_brute_force(spark, make):
    docs = make(spark)
    got = quality_rules.judge(docs).collect()
    want = [(r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in got)


def test_op7_verdict_follows_labels(spark):
    docs = cases.sample(spark, "sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.2


def test_js_distance():
    p = np.array([[1.0, 0], [0.5, 0.5], [0, 0]])
    assert np.allclose(quality_rules.js_distance(p, np.array([1.0, 0])), [0, 0.5579230452841438, 0])


def test_short_texts_are_not_judged_by_distance(spark):
    docs = spark.createDataFrame([(1, " ".join("!!" for _ in range(25)), "en")], "doc_id long, text string, lang string").union(cases.sample(spark).select("doc_id", "text", "lang"))
    assert [r.char_distance for r in quality_rules.judge(docs).collect() if r.n_words == 25 and r.word_chars == 50] == [0.0]


def test_op7_stage_keeps_all_columns(spark):
    docs = cases.documents(spark)
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and out.count() == quality_rules.judge(docs).where("kept").count()


@pytest.mark.parametrize("make", [cases.documents, cases.empty])
def test_op4_and_op5_edge_cases(spark, make):
    docs = make(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (9, 0, 0), (77, 1, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        rows = knn_quality.score(docs, lab).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert all(r.score == 0 for r in rows if r.doc_id in (0, 1))
    rows = ppm_lang.identify(docs).collect()
    assert len(rows) == docs.count()
    assert all((r.lang_pred == "und") == (r.score == 0) for r in rows)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (0, 1, 3))


def test_op4_held_out_accuracy(spark):
    docs, labels = cases.sample(spark, "sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = knn_quality.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_op4_neighbours_equal_brute_force():
    rng = np.random.default_rng(1)
    x = rng.poisson(1.0, (60, knn_quality.FEATURES)).astype(np.float32)
    m = knn_quality.Model(x[:40], np.arange(40) % 2)
    got = m.scores(x[40:])
    for i, row in enumerate(x[40:]):
        v = m.weighted(row[None]) @ m.basis
        cos = (v / np.linalg.norm(v) @ m.points.T)[0]
        near = np.argsort(-cos)[: knn_quality.NEIGHBOURS]
        w = np.maximum(cos[near].astype(float), 0) ** 8
        assert abs(got[i] - (w * m.labels[near]).sum() / w.sum()) < 1e-5


def test_op5_held_out_accuracy(spark):
    docs = cases.sample(spark, "sf0.01")
    rows = ppm_lang.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(held) > 200 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98


def test_op5_code_length_equals_walk_down_the_tree():
    samples = {"a": ["the cat sat on the mat, the hat", "that is the one"] * 3, "b": ["el gato y la gata", "una casa más"] * 3}
    m = ppm_lang.Model({k: ppm_lang.Tree(v) for k, v in samples.items()})
    texts = ["the gato más", "x", "", "zz the cat", "más"]
    got = m.bits(*ppm_lang.folded(pa.array(texts, type=pa.large_string())))
    for k, lang in enumerate(m.langs):
        counts = {}
        for s in samples[lang]:
            b = s.encode()
            for n in range(4):
                for i in range(n, len(b)):
                    counts.setdefault(b[i - n : i], {}).setdefault(b[i], 0)
                    counts[b[i - n : i]][b[i]] += 1
        deep = {int(c).to_bytes(3, "big") for c in m.trees[k].contexts[2]}

        def cost(context, byte):
            here = counts.get(context, {}) if len(context) < 3 or context in deep else {}
            shorter = 8.0 if not context else None
            total, distinct = sum(here.values()), len(here)
            if byte in here:
                return np.log2((total + distinct) / here[byte])
            if shorter is None:
                shorter = cost(context[1:], byte)
            return shorter + (np.log2((total + distinct) / distinct) if distinct else 0)

        for i, t in enumerate(texts):
            b = t.encode()
            assert abs(got[i, k] - sum(cost(b[max(0, j - 3) : j], b[j]) for j in range(len(b)))) < 1e-3
