import hashlib
import re

import cases
import numpy as np
import pytest

from indexloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    index = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            index.setdefault(tuple(w[i : i + window]), set()).add(item)
    lengths = {len(k) for k in index}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (got := index.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= got
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def benchmark(spark):
    rows = [(1, cases.PASSAGE), (2, "The QUICK brown fox"), (3, None), (4, "..."), (5, cases.PASSAGE), (5, cases.PASSAGE), (None, "unknown words de l'été"), (6, "été à la plage un deux trois un deux trois passage0 shared passage1")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("make", [cases.documents, cases.sample, cases.empty])
def test_query_equals_brute_force(spark, make):
    docs = make(spark)
    bench = benchmark(spark) if make is not cases.sample else spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = [tuple(r)[:6] for r in decontam.contamination(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert make is cases.empty or any(r[5] for r in got)


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs, bench = cases.documents(spark), benchmark(spark)
    results = lambda: [sorted(map(str, f(docs, bench).collect())) for f in (decontam.contamination, decontam.remove_contaminated, decontam.longest_matches)]
    whole = results()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert len(list(decontam.item_blocks(bench))) > 3
    assert results() == whole


def test_empty_benchmark(spark):
    rows = decontam.contamination(cases.documents(spark), benchmark(spark).limit(0)).collect()
    assert len(rows) == len(cases.TEXTS) + 4 and not any(r.contaminated for r in rows)


def test_longest_matches_are_verbatim_and_maximal(spark):
    bench = benchmark(spark)
    got = {(r.doc_id, r.item_id, r.item_start, r.doc_start, r.n_words) for r in decontam.longest_matches(cases.documents(spark), bench).collect()}
    n = len(words(cases.PASSAGE))
    assert (11, "1", 0, 0, n) in got and (11, "5", 0, 0, n) in got and (4, "2", 0, 0, 4) in got


def test_suffix_array_is_sorted():
    from indexloom.llm import textops
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abc"), size=rng.integers(0, 40))) for _ in range(20)]
    w = textops.Words(*textops.utf8(pa.array(texts, type=pa.large_string())))
    a = decontam.SuffixArray(w, 16)
    suffix = [tuple(a.text[i : min(a.last[i], i + 16)]) for i in a.order]
    assert suffix == sorted(suffix) and len(set(a.order.tolist())) == len(a.text)


def test_removal_keeps_clean_rows_and_columns(spark):
    docs = cases.documents(spark)
    out = decontam.remove_contaminated(docs, benchmark(spark))
    flags = decontam.contamination(docs, benchmark(spark)).where("not contaminated")
    assert out.columns == docs.columns and out.count() == flags.count() < docs.count()
