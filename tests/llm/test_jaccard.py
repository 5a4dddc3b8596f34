import random
import re

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from indexloom.llm import jaccard_join
from indexloom.llm.components import components


def shingles(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return None
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1)))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    n = len(docs)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = {}
    for i in range(n):
        names.setdefault(find(i), []).append(docs[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return [(docs[i][0], least(names[find(i)]) if sets[i] else docs[i][0], links[i]) for i in range(n)]


def near_copies(seed=0, base_words=120, copies=40, most=9):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def check(spark, docs):
    got = [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.similar_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]), key=str)


@pytest.mark.parametrize("make", [cases.documents, cases.sample, cases.empty])
def test_op6_equals_brute_force(spark, make):
    check(spark, make(spark))


def test_op6_blocks_of_large_groups(spark, monkeypatch):
    texts = near_copies(1) + near_copies(2, 60, 30, 6) + near_copies(1)[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 7)
    check(spark, docs)


def test_pruning_follows_the_posterior():
    from math import comb

    for k in (16, 64, 200):
        m = jaccard_join.least_matches(k, 0.8)
        grid = np.linspace(0, 1, 200_001)
        post = lambda m: (f := grid**m * (1 - grid) ** (k - m) * comb(k, m))[grid >= 0.8].sum() / f.sum()
        assert post(m) >= 0.9 * jaccard_join.TOLERANCE and (m == 0 or post(m - 1) < 1.1 * jaccard_join.TOLERANCE)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_one_of_each_keeps_one_row_of_every_class(spark):
    docs = cases.documents(spark)
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    # the repeated rows of document 4 become one; those without words stay
    assert sum(k[0] == 4 for k in kept) == 1 and {0, 1, 3} <= {k[0] for k in kept}
    # the two rows of id 5 are different documents; the first of them and document 11 are alike
    assert len(kept) == docs.count() - 3 and sum(k[0] in (5, 11) for k in kept) == 2


@pytest.mark.parametrize("tie", [1, 4, 1000])
def test_op6_units_within_groups_and_across_them(spark, monkeypatch, tie):
    """Texts of one chain, of groups of near copies and of loose pairs; whatever is tied, the links are the same."""
    r = random.Random(8)
    words = [f"c{i}" for i in range(400)]
    chain = [" ".join(words[i : i + 100]) for i in range(0, 300, 3)]  # neighbours are alike, distant ones aren't
    loose = [" ".join(r.choice(words[:200]) for _ in range(20)) for _ in range(30)]
    texts = chain + near_copies(5, 120, 40, 3) + near_copies(6, 30, 20, 3) + loose + loose[:4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 9)
    monkeypatch.setattr(jaccard_join, "TIE_BANDS", tie)
    check(spark, docs)


def chain_of(n, step=4, length=60):
    return [(i, " ".join(f"w{j}" for j in range(i * step, i * step + length))) for i in range(n)]


def test_a_long_chain_is_no_group(spark):
    """Its pairs grow with the square of its length, those in its buckets don't: it is compared bucket by bucket."""
    docs = spark.createDataFrame(chain_of(400), "doc_id long, text string")
    sets = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(jaccard_join._set_rows, "doc_id long, text_hash long, node binary, n long, sig binary")
    nodes = sets.select(F.col("doc_id").alias("nid"), "n", "sig").cache()
    bands = nodes.select("nid", "sig").mapInArrow(jaccard_join._band_rows, "key long, band int, nid long")
    shared = bands.join(bands.groupBy("key").agg(F.min("nid").alias("hub"), F.count("*").alias("size")).where("size > 1"), "key").cache()
    sizes = nodes.select("nid", "n")
    groups = jaccard_join._groups(shared, sizes)
    across = jaccard_join._across(shared, groups, sizes)
    assert groups.groupBy("group").count().where("count > 100").count() == 0
    assert jaccard_join._within(groups).count() + across.count() <= 2 * shared.count()
    nodes.unpersist()
    shared.unpersist()


def test_rows_that_share_an_id_or_have_none(spark):
    texts = near_copies(3, 80, 12, 4)
    rows = [(7 if i % 2 else None, t) for i, t in enumerate(texts)] + [(7, texts[1])] * 30 + [(None, texts[0])] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, docs)
    kept = jaccard_join.one_of_each(docs).collect()
    assert len(kept) == len({(c, n) for _, c, n in brute_classes(rows)})


def brute_classes(rows):
    """(place, class as a number, 0) of each row; ids don't name classes here."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [(i, find(i), 0) for i in range(len(rows))]


def test_banding_misses_few_pairs_at_the_threshold():
    """The chance that a pair at 0.8 shares no band, and that pruning drops it, stay as stated."""
    assert (1 - 0.8**jaccard_join.BAND_ROWS) ** jaccard_join.BANDS < 1.4e-7
