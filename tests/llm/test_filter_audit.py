"""The audit of filters against a row-by-row replay of every order."""

import re
from collections import Counter
from itertools import permutations

import cases
import pytest

from indexloom.llm import filter_audit


def failures(rows):
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    for r in rows:
        t = r.text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        yield "".join(
            k for k, bad in [("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)), ("D", bool(set("#$%&*|") & set(t))), ("E", r.doc_id is not None and r.doc_id > least[t])] if bad
        )


def replay(rows, labels):
    good, toxic = ({r.doc_id for r in labels if r[c] == 1 and r.doc_id is not None} for c in ("quality", "toxic"))
    out, shapley = {}, Counter()
    parts = {r.source or "" for r in rows}
    failed = list(zip(rows, failures(rows), strict=True))
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            left = [(r, f) for r, f in failed if (r.source or "") == part]
            every = left
            for step, k in enumerate(order, 1):
                here = [(r, f) for r, f in left if k in f]
                lost = Counter(good=sum(r.doc_id in good for r, _ in here), toxic=sum(r.doc_id in toxic for r, _ in here))
                redundant = sum(k in f for _, f in every) - len(here)
                left = [(r, f) for r, f in left if k not in f]
                out[part, order, step] = (len(left), len(here), redundant, sum(f == k for _, f in every), lost["good"], lost["toxic"])
                shapley[part, k] += len(here)
    return {(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def labels_of(spark, docs):
    rows = [(i, i % 2, i % 3 == 0) for i in range(16)] + [(4, 1, False), (None, 1, True), (99, 1, True), (5, None, None)]
    return spark.createDataFrame([(a, b, None if c is None else int(c), "x") for a, b, c in rows], "doc_id long, quality int, toxic int, part string")


@pytest.mark.parametrize("make", [cases.documents, cases.sample])
def test_equals_replay(spark, make):
    docs = make(spark)
    labels = labels_of(spark, docs)
    got = filter_audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    want = replay(docs.select("doc_id", "text", "source").collect(), labels.collect())
    assert len(rows) == len(want) and set(rows) == want


def test_masks_count_every_document_once(spark):
    docs = cases.documents(spark)
    cells = filter_audit.mask_cells(docs, labels_of(spark, docs)).collect()
    assert sum(r.n for r in cells) == docs.count()
    assert all(r.n_good <= r.n and r.n_toxic <= r.n for r in cells)


def test_copies_by_id_part_and_null(spark):
    rows = [(3, "same", "a"), (1, "same", "b"), (1, "same", "b"), (2, "same", None), (None, "same", "a"), (7, None, "a"), (8, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cells = filter_audit.mask_cells(docs, labels_of(spark, docs).limit(0)).collect()
    copies = Counter({})
    for r in cells:
        copies[r.part] += r.n if r.mask & 16 else 0
    assert copies == {"a": 1, "": 1, "b": 1}  # ids 3, 2 and 8; not the row without an id nor the two rows of id 1


def test_empty_tables(spark):
    docs, labels = cases.empty(spark), labels_of(spark, None)
    assert filter_audit.audit(docs, labels).count() == 0
    few = filter_audit.audit(cases.documents(spark), labels.limit(0))
    assert few.agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)
