"""Repeated words: counts and longest matches against brute force, and their cost."""

import random
import time
import tracemalloc

import pyarrow as pa
import pytest

from indexloom.llm import decontam, textops


def words_of(texts):
    return textops.Words(*textops.utf8(pa.array(texts, type=pa.large_string())))


def longest(doc, item, window):
    """(place, place in the item, words) of the longest match from each place, but those inside an earlier one."""
    d, i = doc.split(), item.split()
    n, reach, out = min(window, len(i)), -1, []
    for p in range(len(d) if i else 0):
        found = []
        for q in range(len(i) - n + 1):
            k = 0
            while p + k < len(d) and q + k < len(i) and d[p + k] == i[q + k]:
                k += 1
            found.append((-k, q))
        k, q = min(found)
        if -k >= n and p - k > reach:
            out.append((p, q, -k))
            reach = p - k
    return out


def covered(doc, items, window):
    d, out = doc.split(), set()
    for item in items:
        i = item.split()
        n = min(window, len(i))
        windows = {tuple(i[q : q + n]) for q in range(len(i) - n + 1)} if n else set()
        out |= {x for p in range(len(d) - n + 1) if tuple(d[p : p + n]) in windows for x in range(p, p + n)}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_shards_of_few_words(seed, monkeypatch):
    dice = random.Random(seed)
    monkeypatch.setattr(decontam, "CHUNK", 7)
    monkeypatch.setattr(decontam, "GROUP_WORDS", 30)
    for _ in range(60):
        letters = "abcde"[: dice.choice([1, 2, 3, 5])]
        text = lambda sizes, more="": " ".join(dice.choice(letters + more) for _ in range(dice.choice(sizes)))  # noqa: E731, B023
        docs = [text([0, 1, 5, 30]) for _ in range(dice.randint(1, 4))]
        items = [text([0, 1, 2, 4, 12, 25], dice.choice(["", "z"])) for _ in range(dice.randint(1, 5))]
        window = dice.choice([2, 3, 4, 10])
        words, block = words_of(docs), decontam.Items(list(range(len(items))), items, window)
        m = decontam.shard_matches(words, block)
        got = sorted(zip(*(m[k].tolist() for k in ("doc", "item", "start", "item_start", "n_words")), strict=True))
        assert got == sorted((a, b, *x) for a, d in enumerate(docs) for b, i in enumerate(items) for x in longest(d, i, window))
        assert decontam._covered(words, decontam.shard_hits(words, block), block).sum() == sum(len(covered(d, items, window)) for d in docs)


def test_cost_follows_the_texts_not_their_product():
    words, items = words_of(["so " * 20_000, "so la " * 10_000]), decontam.Items(["x", "y"], ["so " * 20_000, "la so " * 9_000], 10)
    tracemalloc.start()
    began = time.time()
    hits = decontam.shard_hits(words, items)
    m = decontam.shard_matches(words, items, hits)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 5 and peak < 300e6
    assert decontam._covered(words, hits, items).sum() == 40_000
    assert set(zip(m["doc"].tolist(), m["item"].tolist(), strict=True)) == {(0, 0), (1, 1)} and max(m["n_words"]) == 20_000


def test_junk_in_a_whole_table(spark):
    docs = spark.createDataFrame([(1, "buy " * 20_000), (2, "buy now " * 3), (3, None), (1, "buy " * 20_000)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "buy " * 5_000), ("b", "buy buy"), ("c", "now buy " * 20)], "item_id string, text string")
    rows = sorted(((r.doc_id, r.n_hit, r.n_items, r.longest_match) for r in decontam.contamination(docs, bench).collect()), key=str)
    assert rows == [(1, 20_000, 2, 5_000), (1, 20_000, 2, 5_000), (2, 0, 0, 0), (3, 0, 0, 0)]
