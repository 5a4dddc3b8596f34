"""Benchmark decontamination with suffix arrays over shards of the corpus.

Each slice of documents that a task reads is a shard: prefix doubling sorts all its suffixes, to the
depth of a window. Every different window of the benchmark, which is the head of one of its items' suffixes, is
binary-searched in the shard's array, which gives all places where it stands: hit words and found
items are counted from these ranges, each place once, never from pairs of places. For matches the
suffixes of the documents hit and of the items found are sorted together to their full depth; from each
hit place the longest match in an item is the one with a neighbour among the item's sorted suffixes.
A match inside another of the same item isn't told again, and where an item holds the same words at several
places the first one is told, so matches follow the texts' lengths, however often words repeat.

Words are compared by their bytes, no hash decides. Documents never
move, so copies and common passages cannot pile up in one task. The benchmark goes to the tasks in
blocks of a checked size (BLOCK_BYTES of text, or one item): its measured size gives their number.
The first is part of the plan that is returned; further ones are looked for one after another, each dropped before the next is
made, and leave the few rows that they hit in the shared folder.

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. Null and empty
documents and those without words have no hits; items without words have no windows; items with
fewer words than a window are one window. Repeated rows are judged one by one, repeated items count
once by their id; an item without an id marks words but isn't listed. An empty table gives an empty
result; with an empty benchmark nothing is hit. Extra columns are left out (`remove_contaminated`
keeps them), whatever their names. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.llm import textops

WINDOW = 10
BLOCK_BYTES = 32_000_000


GROUP_WORDS = 400_000  # of items whose suffixes are sorted together with those of the documents that hold them
CHUNK = 200_000  # windows that are searched for at once


def prefix_ranks(text: np.ndarray, last: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 ... words, up to `depth` or until no two are alike; none crosses the end of its text, `last`.

    Words are ranked by their codes. A suffix that ends stands before those that go on.
    """
    n = len(text)
    ranks, k = [text.astype(np.int64)], 1
    while k < depth and n:
        follow = np.arange(n) + k
        key = ranks[-1] * np.int64(n + 1) + np.where(follow < last, ranks[-1][np.minimum(follow, n - 1)] + 1, 0)
        order = np.argsort(key)
        step = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(step[1:] != step[:-1])])
        ranks.append(rank)
        k *= 2
        if rank[order[-1]] == n - 1:
            break
    return ranks


class SuffixArray:
    """Suffixes of the documents of a shard, ordered by their first `depth` words; none crosses a document's end."""

    def __init__(self, words: textops.Words, depth: int = WINDOW):
        self.distinct, self.text = words.distinct, words.id
        self.last = np.repeat(words.offsets[1:], words.counts)  # each word's document's end
        self.order = np.argsort(prefix_ranks(self.text, self.last, depth)[-1], kind="stable")

    def codes(self, values: pa.Array) -> np.ndarray:
        """The shard's codes of words, by their bytes; -1 for words that it doesn't hold."""
        return pc.fill_null(pc.index_in(values, value_set=self.distinct), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def ranges(self, query: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of all queries at once: the range of the array whose suffixes begin with query[i, :lengths[i]]."""
        n = len(self.order)
        out = []
        for after in (False, True):
            low, high = np.zeros(len(query), dtype=np.int64), np.full(len(query), n)
            while (active := low < high).any():
                mid = (low + high) // 2
                place = self.order[np.minimum(mid, n - 1)]
                sign = np.zeros(len(query), dtype=np.int8)  # of suffix against query, over the query's length
                for d in range(query.shape[1]):
                    open_ = (sign == 0) & (d < lengths)
                    if not open_.any():
                        break
                    at = place + d
                    word = np.where(at < self.last[place], self.text[np.minimum(at, n - 1)], -1)
                    sign = np.where(open_, np.sign(word - query[:, d]).astype(np.int8), sign)
                right = active & ((sign < 0) | (after & (sign == 0)))
                low, high = np.where(right, mid + 1, low), np.where(active & ~right, mid, high)
            out.append(low)
        return out[0], out[1]


class Items:
    """A block of benchmark items: their words as codes into a vocabulary of the block, and their different windows, each with the items that hold it."""

    def __init__(self, ids: list, texts: list, window: int):
        words = textops.Words(*textops.utf8(pa.array([t or "" for t in texts], type=pa.large_string())))
        self.window = window
        self.vocabulary, self.words, self.offsets = words.distinct, words.id.astype(np.int32), words.offsets
        counts = words.counts
        n_windows = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        item = np.repeat(np.arange(len(ids)), n_windows)
        first = words.offsets[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        last = np.repeat(words.offsets[1:], counts)
        # equal windows: equal in their first words, as many as a power of two, and in their last ones
        ranks = prefix_ranks(words.id, last, window)
        half = 1 << (window.bit_length() - 1)
        level = ranks[min(window.bit_length() - 1, len(ranks) - 1)]
        behind = first + window - half
        key = level[first] * np.int64(len(last) + 1) + np.where(behind < last[first], level[np.minimum(behind, len(last) - 1)] + 1, 0) if len(first) else first
        _, at, same = np.unique(key, return_index=True, return_inverse=True)
        self.first, self.length = first[at], np.minimum(counts, window)[item[at]].astype(np.int32)  # of each different window
        holds = np.unique(same * np.int64(max(len(ids), 1)) + item)
        self.item = (holds % max(len(ids), 1)).astype(np.int32)  # items of each window, one after another
        self.items_from = np.searchsorted(holds, np.arange(len(at) + 1) * np.int64(max(len(ids), 1)))
        self.ids = [None if i is None else str(i) for i in ids]

    def known(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows all of whose words a shard holds, their words as the shard's codes), some at a time."""
        mine = codes[self.words] if len(self.words) else np.zeros(0, np.int64)
        missing = np.concatenate([[0], np.cumsum(mine < 0)])
        rows = np.flatnonzero(missing[self.first + self.length] == missing[self.first])
        for k in range(0, len(rows), CHUNK):
            part = rows[k : k + CHUNK]
            at = self.first[part][:, None] + np.arange(self.window)
            yield part, np.where(np.arange(self.window) < self.length[part][:, None], mine[np.minimum(at, len(mine) - 1)], 0)


def block_count(benchmark: DataFrame, limit: int) -> int:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first().n
    return max(1, -(-int(size) // limit))


def item_blocks(benchmark: DataFrame, window: int = WINDOW, limit: int | None = None) -> Iterator[Broadcast]:
    """The benchmark as broadcast blocks, each of about `limit` bytes of text at most, made one after another."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = block_count(items, limit or BLOCK_BYTES)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = part.distinct().collect()  # one block, of a checked size
        yield spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], window))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for all numbers from low[row] on and below high[row]."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


@dataclass(frozen=True)
class Hits:
    """Places of a shard where windows stand: place and window of each, one for each different window there; and the array's codes of the items' words."""

    at: np.ndarray
    window: np.ndarray
    codes: np.ndarray


def shard_hits(words: textops.Words, items: Items) -> Hits:
    """Where the windows stand in the shard. A place begins one window of full length at most, and one of each shorter length."""
    none = np.zeros(0, dtype=np.int64)
    if not len(words.id) or not len(items.first):
        return Hits(none, none, none)
    array = SuffixArray(words, items.window)
    codes = array.codes(items.vocabulary)
    at, window = [none], [none]
    for rows, query in items.known(codes):
        low, high = array.ranges(query, items.length[rows])
        row, place = _spread(low, high)
        at.append(array.order[place])
        window.append(rows[row])
    return Hits(np.concatenate(at), np.concatenate(window), codes)


def _doc_of(words: textops.Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.offsets, at, side="right") - 1


def _covered(words: textops.Words, hits: Hits, items: Items) -> np.ndarray:
    """Tells of each word of the shard whether a window covers it."""
    step = np.zeros(len(words.id) + 1, dtype=np.int64)
    np.add.at(step, hits.at, 1)
    np.add.at(step, hits.at + items.length[hits.window], -1)
    return np.cumsum(step)[:-1] > 0


def shard_matches(words: textops.Words, items: Items, hits: Hits | None = None) -> dict[str, np.ndarray]:
    """Longest verbatim matches of a shard: document, item, places in both and length, all in words; none inside another of its item, each at its first place in the item."""
    hits = hits or shard_hits(words, items)
    # the items of each place's windows
    row, k = _spread(items.items_from[hits.window], items.items_from[hits.window + 1])
    at, item = hits.at[row], items.item[k].astype(np.int64)
    pair = np.unique(at * np.int64(max(len(items.ids), 1)) + item)
    at, item = pair // max(len(items.ids), 1), pair % max(len(items.ids), 1)
    found, size = np.unique(item), np.diff(items.offsets)
    group = np.cumsum(size[found]) // GROUP_WORDS
    parts = []
    for g in np.unique(group):
        mine = np.isin(item, found[group == g])
        parts.append(_longest(words, items, hits.codes, at[mine], item[mine]))
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("doc", "item", "item_start", "start", "n_words")}
    at, item, place, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc = _doc_of(words, at)
    order = np.lexsort((place, at, item, doc))
    return {"doc": doc[order], "item": item[order], "item_start": place[order], "start": (at - words.offsets[doc])[order], "n_words": n[order]}


def _longest(words: textops.Words, items: Items, codes: np.ndarray, at: np.ndarray, item: np.ndarray):
    """Of all (place, item) the longest matches: place, item, first place in the item, number of words."""
    docs, own = np.unique(_doc_of(words, at)), np.unique(item)
    starts = np.concatenate([words.offsets[docs], items.offsets[own]])
    counts = np.concatenate([words.offsets[docs + 1], items.offsets[own + 1]]) - starts
    ends = np.cumsum(counts)
    n_docs = len(docs)
    split = int(ends[n_docs - 1])  # documents stand before it, items behind
    source = np.arange(ends[-1]) + np.repeat(starts - ends + counts, counts)
    strange = len(words.distinct) + items.words[source[split:]]  # words of items that the shard doesn't hold
    there = codes[items.words[source[split:]]]
    text = np.concatenate([words.id[source[:split]], np.where(there < 0, strange, there)])
    _, text = np.unique(text, return_inverse=True)
    last = np.repeat(ends, counts)
    levels = prefix_ranks(text, last, int(counts.max()) + 1)
    full = levels[-1]

    def common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words two suffixes have in common at their beginning."""
        n = np.zeros(len(p), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            fits = np.minimum(last[p] - p, last[q] - q) - n >= 1 << k
            a, b = np.minimum(p + n, len(text) - 1), np.minimum(q + n, len(text) - 1)
            n += np.where(fits & (levels[k][a] == levels[k][b]), 1 << k, 0)
        return n

    # suffixes of the items, each item's in order
    number = np.repeat(np.arange(len(own)), counts[n_docs:])
    mine = np.arange(split, len(text))
    order = np.lexsort((mine, full[mine], number))
    suffix, key = mine[order], number[order] * np.int64(len(text) + 1) + full[mine][order]
    low = np.concatenate([[0], np.cumsum(counts[n_docs:])])
    i = np.searchsorted(own, item)
    d = np.searchsorted(docs, _doc_of(words, at))
    p = at - words.offsets[docs[d]] + (ends - counts)[d]
    near = np.searchsorted(key, i * np.int64(len(text) + 1) + full[p])
    best = np.zeros(len(p), dtype=np.int64)
    for side in (near - 1, near):
        inside = (side >= low[i]) & (side < low[i + 1])
        best = np.maximum(best, np.where(inside, common(p, suffix[np.clip(side, 0, len(suffix) - 1)]), 0))
    # those that reach beyond all that begin before them
    turn = np.lexsort((p, i, d))
    reach = (p + best)[turn]
    block = np.flatnonzero(np.diff(d[turn] * np.int64(len(own) + 1) + i[turn], prepend=-1))
    shift = np.repeat(np.arange(len(block)), np.diff(np.append(block, len(turn)))) * np.int64(len(text) + 1)
    before = np.concatenate([[-1], np.maximum.accumulate(reach + shift)[:-1]])
    first = np.zeros(len(turn), dtype=bool)
    first[block] = True
    keep = turn[first | (reach + shift > before)]
    p, i, best, near = p[keep], i[keep], best[keep], near[keep]
    # the suffixes of the item with as long a match stand together around the neighbours; the first place among them counts
    edges = []
    for step, known in ((-1, near), (1, near - 1)):
        width = 1 << int(counts[n_docs:].max()).bit_length()
        while width:
            probe = known + step * width
            inside = (probe >= low[i]) & (probe < low[i + 1])
            fits = inside & (common(p, suffix[np.clip(probe, 0, len(suffix) - 1)]) >= best)
            known = np.where(fits, probe, known)
            width //= 2
        edges.append(known)
    place = _least(suffix, edges[0], edges[1]) - (ends - counts)[n_docs + i]
    return at[keep], item[keep], place, best


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first:last + 1], by minima over runs of a power of two."""
    runs = [values]
    while (1 << len(runs)) <= len(values):
        half = 1 << (len(runs) - 1)
        runs.append(np.minimum(runs[-1][:-half], runs[-1][half:]))
    k = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.empty(len(first), dtype=np.int64)
    for level in np.unique(k):
        m = k == level
        out[m] = np.minimum(runs[level][first[m]], runs[level][last[m] - (1 << level) + 1])
    return out


def _in_shards(work):
    """work(part, words) for each shard of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, limit=3_000_000):
                yield work(part, textops.Words(*textops.utf8(textops.text_column(part))))

    return run


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()), ("matches", pa.string())])


_FIND = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
_STATE = "doc_id long, text_hash long, block int, n_words long, covered binary, matches array<struct<item_id:string,item_start:long,doc_start:long,n_words:long>>"
_STATE_ARROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("block", pa.int32()), ("n_words", pa.int64()), ("covered", pa.binary()), ("matches", pa.list_(_FIND))])


def _look(block: Broadcast, number: int):
    """One block's finds in each row: covered words as bits, longest matches. Without the text; the first block tells of all rows, others of those that they hit."""

    def work(part: pa.RecordBatch, words: textops.Words) -> pa.RecordBatch:
        items = block.value
        hits = shard_hits(words, items)
        m = shard_matches(words, items, hits)
        covered = _covered(words, hits, items)
        found: list[list] = [[] for _ in range(part.num_rows)]
        for d, i, *places in zip(*(m[k].tolist() for k in ("doc", "item", "item_start", "start", "n_words")), strict=True):
            found[d].append((items.ids[i], *places))
        bits = [np.packbits(covered[a:b]).tobytes() if f else None for f, a, b in zip(found, words.offsets[:-1], words.offsets[1:], strict=True)]
        rows = [[dict(zip(("item_id", "item_start", "doc_start", "n_words"), x, strict=True)) for x in f] for f in found]
        out = textops.batch_of(_STATE_ARROW, part.column(0).cast(pa.int64()), part.column(2), np.full(part.num_rows, number, dtype=np.int32), words.counts, bits, rows)
        return out if number == 0 else out.filter(pa.array([bool(f) for f in found]))

    return _in_shards(work)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a row's finds in all blocks (doc_id, n_words, parts) to its counts."""
    for batch in batches:
        hit, names, longest, places = [], [], [], []
        for parts in batch.column(2).to_pylist():
            bits, found = np.zeros(0, dtype=np.uint8), set()
            for p in parts:
                if p["covered"]:
                    new = np.frombuffer(p["covered"], dtype=np.uint8)
                    bits = new if not len(bits) else bits | new
                found.update((x["doc_start"], x["item_id"] or "", x["item_start"], x["n_words"], x["item_id"] is None) for x in p["matches"])
            hit.append(int(np.bitwise_count(bits).sum()))
            names.append(sorted({x[1] for x in found if not x[4]}))
            longest.append(max((x[3] for x in found), default=0))
            places.append(",".join(f"{item}:{of}:{at}:{n}" for at, item, of, n, _ in sorted(found)))
        hits = np.array(hit, dtype=np.int64)
        yield textops.batch_of(_DIGEST, batch.column(0), batch.column(1), hits, [len(x) for x in names], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], hits > 0, longest, places)


def _rows(docs: DataFrame) -> DataFrame:
    return textops.narrow(docs, F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def _further(docs: DataFrame, blocks: Iterator[Broadcast]) -> DataFrame | None:
    """What the blocks behind the first hit, written block by block: none is held while the next is looked for."""
    found = None
    for k, block in enumerate(blocks, 1):
        part = textops.cut(_rows(docs).mapInArrow(_look(block, k), _STATE), "block-finds")
        block.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts of words, hit words and found items of every row of docs (doc_id, text), the length of its longest match, and its matches as item:place in it:place in the text:words.

    The first block of the benchmark is looked for in a pass that gives a row for each document, each
    further block in a pass that gives rows for what it hits, without texts; those few are joined on.
    """
    blocks = item_blocks(benchmark, window)
    first = _rows(docs).mapInArrow(_look(next(blocks), 0), _STATE)
    others = _further(docs, blocks)
    part = F.struct("covered", "matches")
    if others is None:
        rows = first.select("doc_id", "n_words", F.array(part).alias("parts"))
    else:
        key = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("text_hash") == F.col("_h")]
        # repeated rows have equal finds; a row has one for each block at most
        more = others.dropDuplicates(["doc_id", "text_hash", "block"]).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_list(part).alias("more"))
        rows = first.join(more, key, "left").select("doc_id", "n_words", F.concat(F.array(part), F.coalesce("more", F.array())).alias("parts"))
    return rows.mapInArrow(_summary, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, matches string")


_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])


def _match_rows(block: Broadcast):
    def work(part: pa.RecordBatch, words: textops.Words) -> pa.RecordBatch:
        items = block.value
        m = shard_matches(words, items)
        keys = part.column(0).cast(pa.int64()).to_pylist()
        return textops.batch_of(_MATCH, [keys[d] for d in m["doc"]], [items.ids[i] for i in m["item"]], m["item_start"], m["start"], m["n_words"])

    return _in_shards(work)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every longest verbatim match of `window` words or more (or a whole shorter item): document, item and places in words."""
    rows, found = textops.narrow(docs, "doc_id", "text"), None
    for k, block in enumerate(item_blocks(benchmark, window)):
        part = rows.mapInArrow(_match_rows(block), "doc_id long, item_id string, item_start long, doc_start long, n_words long")
        if k:
            part = textops.cut(part, "block-matches")
            block.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _clean(block: Broadcast):
    def work(part: pa.RecordBatch, words: textops.Words) -> pa.RecordBatch:
        doc = _doc_of(words, shard_hits(words, block.value).at)
        return part.filter(pa.array(np.bincount(doc, minlength=part.num_rows) == 0))

    return _in_shards(work)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, that hold no window of a benchmark item: a filter in the row for the first block, an anti join with the few rows that further blocks hit."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    blocks = item_blocks(benchmark, window)
    kept = textops.narrow(docs).mapInArrow(_clean(next(blocks)), schema)
    others = _further(docs, blocks)
    if others is not None:
        hit = others.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
        kept = kept.join(hit, kept["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(kept["text"]) == F.col("_h")), "left_anti")
    return kept
