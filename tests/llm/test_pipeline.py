import hashlib

import cases
import corpus_pipeline
import numpy as np
import test_decontam
import test_jaccard
import test_pii
import test_quality
from tokenizers import Tokenizer

from indexloom.llm import pii, quality_rules
from indexloom.llm.wordcode import public_path


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not test_quality.brute(r.text)[5] and verdict[r.doc_id]]
    classes = test_jaccard.brute(rows)
    best = {}
    for (doc_id, text), (_, cls, _) in zip(rows, classes, strict=True):
        best.setdefault(cls, (doc_id, text))
        best[cls] = min(best[cls], (doc_id, text))
    rows = sorted(best.values())
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    bad = {r[0] for r in test_decontam.brute(rows, [(b.item_id, b.text) for b in bench]) if r[5]}
    tok = Tokenizer.from_file(public_path())
    want = []
    for doc_id, text in rows:
        if doc_id not in bad:
            assert [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE_KINDS] == test_pii.brute(text)
            ids = tok.encode(pii.redact_text(text, pii.find_spans(text)), add_special_tokens=False).ids
            want.append((doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()))
    got = sorted(tuple(r)[:3] for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted(want) and 0 < len(got) < docs.count()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_edge_cases_pass_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, shared and missing ids, clashing columns; every document of the library's edge cases."""
    good = " ".join(f"plain words of number {i} and mail me at jo{i}@example.com" for i in range(12))
    docs = cases.documents(spark)
    more = spark.createDataFrame([(50, good, "en", "s", 1), (50, good, "en", "s", 1), (51, good, "en", "s", 1), (None, good + " more of it", None, None, None), (None, good + " more of it", None, None, None)], cases.SCHEMA)
    docs = docs.unionByName(more, allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, cases.PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, str(tmp_path))
        assert sorted(stage_docs.columns) == sorted(docs.columns)
    kept = [(r.doc_id, r.text) for r in stage_docs.collect()]
    assert not any(x in (0, 1, 2, 3, 11) for x, _ in kept) and sum("plain words" in t for _, t in kept) == 1
    assert all("@example.com" not in t for _, t in kept if "plain words" in t)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)
