"""Similarity join of documents on the Jaccard index of their word shingles.

1. A document's distinct five-word shingles (all its words, if fewer) are hashed to 64 bits; equal
   sets get one node, so copies are one row from here on. Each node has 200 MinHash values, worked
   out once and kept beside it.
2. Nodes that agree in one of 40 bands of five values share a bucket and are candidates. A pair at
   the threshold 0.8 misses all bands with probability 1.3e-7.
3. Candidates are compared in units of two blocks of a bounded number of nodes and shingles, laid
   out so that the work follows the number of candidate pairs:
   a. nodes that share TIE_BANDS bands or more with the least node of those buckets are tied, and the
      components of the ties are groups. In a group with no more pairs than its buckets hold, as
      one of many near copies, all pairs are compared once. Other groups, as long chains, are let go.
   b. in each bucket that holds nodes of several groups, pairs of different groups are compared, each
      in the first band that it shares. Their MinHash values are moved first; texts only of nodes
      that still have a partner.
   Pairs are compared by their MinHash values a few at a time and dropped as soon as the posterior
   probability (uniform prior) of reaching the threshold falls below TOLERANCE; the rest is verified
   exactly on the shingle sets. A unit returns, for each of its nodes, the number of partners and
   one parent in a spanning forest: the links of a group of m alike documents are all compared
   and counted but never written out as m*m/2 rows.
4. Components over the verified links give the classes.

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. Null and empty
texts and those without words link to nothing, not even to each other. Repeated rows are copies of
each other. A class is named by its least doc_id (null if none of its rows has an id); ties between
rows for a class's place go to the least (doc_id, hash of the text). An empty table gives an empty
result. Extra columns are left out (`one_of_each` keeps them), whatever their names. Texts are taken
whole. Shingles are compared by 64-bit hashes of their words' bytes: two sets of a thousand shingles
differ in one by such an error with probability 1e-13.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm import textops
from indexloom.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)
BANDS = 40
BAND_ROWS = 5
HASHES = BANDS * BAND_ROWS
STEPS = (16, 32, 64, 128, HASHES)
TOLERANCE = 1e-9
TIE_BANDS = 4
BLOCK_NODES = 256
BLOCK_SHINGLES = 1_000_000

_RNG = np.random.default_rng(20_240_229)
_MULTIPLY = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_MULTIPLY_HIGH = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, with offsets."""
    words = textops.Words(*textops.utf8(texts))
    counts = words.counts
    docs = len(texts)
    owner = words.doc_of_word()
    h = textops.shingle_hashes(words.hash, n)
    whole = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool)
    h, doc = h[whole], owner[: len(h)][whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if short.size:
        extra = np.array([textops.mix(np.array([_fold(words.hash[words.offsets[d] : words.offsets[d + 1]])], dtype=np.uint64))[0] for d in short], dtype=np.uint64)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(docs + 1))


def _fold(words: np.ndarray) -> int:
    out = len(words)
    for w in words.tolist():
        out = (out * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
    return out


def node_keys(h: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each set; none for an empty one."""
    full = np.flatnonzero(np.diff(offsets))
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    if full.size:
        starts = offsets[:-1][full]
        a = np.add.reduceat(textops.mix(h), starts)
        b = np.add.reduceat(textops.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        pairs = np.stack([a, b], axis=1).astype(">u8")
        for i, d in enumerate(full):
            out[d] = pairs[i].tobytes()
    return out


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values (documents x HASHES); an empty set has all ones."""
    out = np.full((len(offsets) - 1, HASHES), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if full.size:
        low, high, starts = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32), offsets[:-1][full]
        value, other = np.empty_like(low), np.empty_like(low)
        columns = np.empty((HASHES, len(full)), dtype=np.uint32)
        for k in range(HASHES):
            np.multiply(low, _MULTIPLY[k], out=value)
            np.multiply(high, _MULTIPLY_HIGH[k], out=other)
            np.add(value, other, out=value)
            np.minimum.reduceat(value, starts, out=columns[k])
        out[full] = columns.T
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """documents x BANDS keys."""
    out = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for r in range(BAND_ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::BAND_ROWS].astype(np.uint64)
    return textops.mix(out * np.uint64(0xD6E8FEB86659FD93) + np.arange(BANDS, dtype=np.uint64))


@lru_cache
def least_matches(k: int, threshold: float, tolerance: float = TOLERANCE) -> int:
    """The least number m of equal values among k for which P(J >= threshold | m) >= tolerance.

    With a uniform prior J is Beta(m + 1, k - m + 1), whose upper tail at t is P(Binomial(k + 1, t) <= m).
    """
    tail = 0.0
    for m in range(k + 1):
        tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        if tail >= tolerance:
            return m
    return k


_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("sig", pa.binary())])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.slices(batch, limit=1_500_000):
            h, offsets = shingle_sets(textops.text_column(part))
            sig = signatures(h, offsets).astype("<u4")
            yield textops.batch_of(_SETS, part.column(0).cast(pa.int64()), part.column(2), node_keys(h, offsets), np.diff(offsets), [x.tobytes() for x in sig])


def _signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, HASHES)


_BAND_ROWS = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("nid", pa.int64())])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_signatures_of(batch.column(1))).view(np.int64)
        yield textops.batch_of(_BAND_ROWS, keys.reshape(-1), np.tile(np.arange(BANDS, dtype=np.int32), len(keys)), np.repeat(batch.column(0).to_numpy(), BANDS))


_LINKS = pa.schema([("nid", pa.int64()), ("parent", pa.int64()), ("links", pa.int64())])


class Unit:
    """Two blocks of nodes (or one), and which of their pairs are to be compared.

    `groups` and `band` say that only pairs of different groups count that share no band before `band`.
    """

    def __init__(self, sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, groups: np.ndarray | None = None, band: int = -1, threshold: tuple[int, int] = THRESHOLD):
        self.sig, self.size, self.left, self.right, self.groups, self.band, self.threshold = sig, size, left, right, groups, band, threshold
        self.keys = band_keys(sig)[:, :band] if band > 0 else None

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each node of the left block with those of the right that may be as alike as the threshold."""
        up, down = self.threshold
        for i, u in enumerate(self.left):
            near = self.right[i + 1 :] if self.left is self.right else self.right
            near = near[(self.size[near] * down >= self.size[u] * up) & (self.size[u] * down >= self.size[near] * up)]
            if self.band >= 0:
                near = near[self.groups[near] != self.groups[u]]
            equal, at = np.zeros(len(near), dtype=np.int64), 0
            for k in STEPS:
                if not near.size:
                    break
                equal += (self.sig[near, at:k] == self.sig[u, at:k]).sum(axis=1)
                fit = equal >= least_matches(k, up / down)
                near, equal, at = near[fit], equal[fit], k
            if self.keys is not None and near.size:
                near = near[(self.keys[near] != self.keys[u]).all(axis=1)]
            if near.size:
                yield int(u), near


def verify(unit: Unit, h: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit's links, verified on the shingle sets: partners' weights and a forest of parents."""
    up, down = unit.threshold
    vocabulary, ids = np.unique(h, return_inverse=True)
    mark = np.zeros(len(vocabulary), dtype=bool)
    links = np.zeros(len(unit.size), dtype=np.int64)
    parent = np.arange(len(unit.size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, near in unit.pairs():
        mine = ids[offsets[u] : offsets[u + 1]]
        mark[mine] = True
        n = unit.size[near]
        at = np.arange(n.sum()) + np.repeat(offsets[near] - (np.cumsum(n) - n), n)
        common = np.add.reduceat(mark[ids[at]].astype(np.int64), np.cumsum(n) - n)
        mark[mine] = False
        for v in near[(up + down) * common >= up * (unit.size[u] + n)].tolist():
            links[u] += weight[v]
            links[v] += weight[u]
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    for x in range(len(unit.size)):
        parent[x] = root(x)
    return links, parent


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by the unit's four numbers (key, band, i, j); a unit ends where they change."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(4)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]]), strict=True):
            if held and tuple(keys[a]) != key:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            key = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sides(unit: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the unit's two blocks; the same object twice if it is one block."""
    block, i, j = unit.column(4).to_numpy()[rows], unit.column(2)[0].as_py(), unit.column(3)[0].as_py()
    left = rows[block == i]
    return left, left if i == j else rows[block == j]


_UNIT = "key long, band int, i int, j int, block int, nid long, group long"
_UNIT_ARROW = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("nid", pa.int64()), ("group", pa.int64())])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each unit (with n and sig) the nodes that have a partner left after the MinHash values."""
    for unit in _units(batches):
        left, right = _sides(unit, np.arange(unit.num_rows))
        work = Unit(_signatures_of(unit.column(8)), unit.column(7).to_numpy(), left, right, unit.column(6).to_numpy(), unit.column(1)[0].as_py())
        alive = np.zeros(unit.num_rows, dtype=bool)
        for u, near in work.pairs():
            alive[u] = True
            alive[near] = True
        if alive.any():
            yield textops.batch_of(_UNIT_ARROW, *unit.filter(pa.array(alive)).columns[:7])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each unit (with copies, node and text)."""
    for unit in _units(batches):
        h, offsets = shingle_sets(textops.text_column(unit))
        # a text's hash may stand for another text too: only rows of the node's own set count
        good = np.flatnonzero([a == b for a, b in zip(node_keys(h, offsets), unit.column(8).to_pylist(), strict=True)])
        left, right = _sides(unit, good)
        work = Unit(signatures(h, offsets), np.diff(offsets), left, right, unit.column(6).to_numpy(), unit.column(1)[0].as_py())
        links, parent = verify(work, h, offsets, unit.column(7).to_numpy())
        linked = np.flatnonzero(links > 0)
        names = unit.column(5).to_numpy()
        yield textops.batch_of(_LINKS, names[linked], names[parent[linked]], links[linked])


def _dealt(units: DataFrame) -> DataFrame:
    """Units of one key go to partitions one after another, so that a large group's units spread evenly."""
    partitions = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.floor(F.col("j").cast("long") * (F.col("j") + 1) / 2).cast("long") + F.col("i")
    return units.repartitionById(partitions, F.pmod(F.pmod(F.xxhash64("key"), F.lit(partitions)) + number, F.lit(partitions)).cast("int")).sortWithinPartitions("key", "band", "i", "j")


def _blocks(count: str, shingles: str):
    return F.greatest(F.ceil(F.col(count) / BLOCK_NODES), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _groups(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """(nid, group, n) of the nodes in groups of near copies: ties' components, as far as comparing all their pairs is no more work than comparing those in their buckets."""
    ties = shared.where("nid != hub").groupBy("nid", "hub").count().where(F.col("count") >= TIE_BANDS)
    comps = components(ties.select(F.col("nid").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("nid"), F.col("comp").alias("group"))
    in_buckets = shared.join(comps, "nid").groupBy("key", "group").agg(F.count("*").alias("s")).groupBy("group").agg(F.sum(F.col("s") * F.col("s")).alias("work"))
    dense = comps.groupBy("group").agg(F.count("*").alias("m")).join(in_buckets, "group").where(F.col("m") * F.col("m") <= F.col("work")).select("group")
    return textops.cut(comps.join(dense, "group").join(sizes, "nid").select("nid", "group", "n"), "groups")


def _within(groups: DataFrame) -> DataFrame:
    """Units of all pairs of each group."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("s")).select("group", _blocks("m", "s").alias("blocks"))
    rows = groups.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.col("group").alias("key"), F.lit(-1).alias("band"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "nid", "group")


def _across(shared: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Units of the buckets that hold several groups. The largest group of a bucket has blocks of its own, which meet the others' blocks only."""
    rows = shared.select("key", "band", "nid").join(groups.select("nid", "group"), "nid", "left").withColumn("group", F.coalesce("group", "nid")).join(sizes, "nid")
    parts = rows.groupBy("key", "group").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    buckets = parts.groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("m", "group", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s")).where("groups > 1")
    own = F.col("top.m") > BLOCK_NODES // 4
    buckets = buckets.select("key", F.when(own, F.col("top.group")).alias("main"), F.when(own, F.col("top.m")).otherwise(0).alias("mm"), F.when(own, F.col("top.s")).otherwise(0).alias("ms"), "m", "s")
    buckets = buckets.select("key", "main", _blocks("mm", "ms").alias("of_main"), (F.col("m") - F.col("mm")).alias("m"), (F.col("s") - F.col("ms")).alias("s")).select("key", "main", "of_main", _blocks("m", "s").alias("of_rest"))
    rows = rows.join(buckets, "key").withColumn("is_main", F.coalesce(F.col("group") == F.col("main"), F.lit(False)))
    spread = F.xxhash64("nid", "key")
    block = F.when(F.col("is_main"), F.col("of_rest") + F.pmod(spread, F.greatest("of_main", F.lit(1)))).otherwise(F.pmod(spread, F.col("of_rest"))).cast("int")
    last = F.when(F.col("is_main"), F.col("of_rest")).otherwise(F.col("of_rest") + F.col("of_main")) - 1
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "nid", "group")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows has doc_id, text_hash and node of every row; nodes has node, nid, comp, rep_id, copies and links."""
    spark = docs.sparkSession
    sets = textops.cut(textops.narrow(docs, "doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_set_rows, "doc_id long, text_hash long, node binary, n long, sig binary"), "sets")
    # equal sets meet in two steps, so that a set with thousands of copies sends no row for each task to one place
    once = sets.where("node is not null").groupBy("node", (F.spark_partition_id() % 16).alias("salt")).agg(F.min("doc_id").alias("rep_id"), F.min(F.struct("doc_id", "text_hash")).alias("source"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = once.groupBy("node").agg(F.min("rep_id").alias("rep_id"), F.min("source").alias("source"), F.sum("copies").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes, nodes_path = textops.put(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("nid", "sig").mapInArrow(_band_rows, "key long, band int, nid long")
    hubs = bands.groupBy("key").agg(F.min("nid").alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub")
    shared, shared_path = textops.put(bands.join(hubs, "key"), "buckets")
    sizes = nodes.select("nid", "n")
    groups = _groups(shared, sizes)

    across = _across(shared, groups, sizes).join(nodes.select("nid", "n", "sig"), "nid").select("key", "band", "i", "j", "block", "nid", "group", "n", "sig")
    left, left_path = textops.put(_dealt(across).mapInArrow(_prune, _UNIT), "pruned")
    units = _within(groups).unionByName(left)
    wanted = units.select("nid").distinct().join(nodes.select("nid", "source"), "nid").select("nid", F.col("source.doc_id").alias("_d"), F.col("source.text_hash").alias("_h"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))).groupBy("nid").agg(F.first("text").alias("text"))
    full = units.join(nodes.select("nid", "copies", "node"), "nid").join(texts, "nid").select("key", "band", "i", "j", "block", "nid", "group", "copies", "node", "text")
    verified, verified_path = textops.put(_dealt(full).mapInArrow(_verify, "nid long, parent long, links long"), "links")
    final = components(verified.where("nid != parent").select(F.col("nid").alias("a"), F.col("parent").alias("b")).distinct())
    links = verified.groupBy("nid").agg(F.sum("links").alias("links"))
    result = nodes.select("node", "nid", "rep_id", "copies").join(final.withColumnRenamed("node", "nid"), "nid", "left").join(links, "nid", "left")
    result = textops.cut(result.select("node", "nid", F.coalesce("comp", "nid").alias("comp"), "rep_id", "copies", F.coalesce("links", F.lit(0)).alias("links")), "classes")
    textops.drop(spark, nodes_path, shared_path, left_path, verified_path)
    return sets.select("doc_id", "text_hash", "node"), result


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): class_id, rep_id (least doc_id with the same shingles) and n_links, the number of other rows at 0.8 or more."""
    rows, nodes = classes(docs)
    names = nodes.groupBy("comp").agg(F.min("rep_id").alias("class_id"), F.sum("copies").alias("class_size"))
    per_node = nodes.join(names, "comp").select("node", "class_id", "class_size", "rep_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    linked = rows.where("node is not null").join(per_node, "node").select("doc_id", "class_id", "rep_id", "n_links", "class_size")
    alone = rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one row of each class: the one with the least (doc_id, hash of the text). Rows without words all stay."""
    rows, nodes = classes(docs)
    keys = ["doc_id", "text_hash"]
    best = rows.where("node is not null").join(nodes.select("node", "comp"), "node").groupBy("comp").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    copies = rows.where("node is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    null_safe = lambda a, b: (a["doc_id"].eqNullSafe(b["_d"])) & (a["text_hash"] == b["_h"])
    named = best.withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    stay = copies.join(named, null_safe(copies, named)).select("_d", "_h", (F.col("n") > 1).alias("_r"))
    empty = rows.where("node is null").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.lit(False).alias("_r")).distinct()
    stay = textops.cut(stay.unionByName(empty), "stay")
    once, repeated = stay.where("not _r"), stay.where("_r")
    same = lambda s: docs["doc_id"].eqNullSafe(s["_d"]) & (F.xxhash64(docs["text"]) == s["_h"])
    # rows that repeat in id and text, few or none: one of each stays
    return docs.join(once, same(once), "left_semi").unionByName(docs.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
