"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed byte trigrams and of word features (shape, length, whether the word
repeats the one before). A bounded sample of labelled documents (SAMPLE rows in the mean, twice that
at most, drawn by a hash of their id) fixes the weights of the features and, by a truncated singular value
decomposition, a latent space of RANK dimensions. Their vectors and labels, a few hundred kB, are
broadcast; every document's cosines with all of them are worked out in blocks, exactly, and its
NEIGHBOURS nearest vote for their labels with weights that grow with similarity.

Null and empty texts have no features; their score is 0. Texts that are unlike all of the sample
get the sample's mean label. Ties among neighbours go to the lower rank in the sample. Repeated
documents are scored alike, row by row; a label row without a document, or a document labelled
twice, adds what it has; of several rows with one id the least text is learnt. With no labels every score is 0. Extra columns are left out. Texts are
taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm import textops

SAMPLE = 4000
RANK = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
TRIGRAMS = 1024
SHAPES = 512
FEATURES = TRIGRAMS + SHAPES
BLOCK = 1024

_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_KIND = np.zeros(256, dtype=np.uint8)  # of a byte of a word: bits for lower, upper, digit, beyond ASCII, mark, symbol
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 4
_KIND[0x80:] = 1
_KIND[list(b".,;:'\"-()?!")] = 16
_KIND[list(b"#*$%&|<>@=_/\\+~^[]{}")] = 32
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[list(b" \t\n\v\f\r")] = False


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0; a row without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs, n = len(offsets) - 1, len(buf)
    out = np.zeros((docs, FEATURES), dtype=np.float32)
    if n > 2:
        doc = np.repeat(np.arange(docs), np.diff(offsets))
        b = buf.astype(np.uint32)
        code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)
        same = doc[:-2] == doc[2:]
        out[:, :TRIGRAMS] = np.bincount(doc[:-2][same] * TRIGRAMS + (code[same] % TRIGRAMS), minlength=docs * TRIGRAMS).reshape(docs, TRIGRAMS)
    words = textops.Words(buf, offsets, word_byte=_NOT_SPACE, lower=False)
    if len(words.id):
        kinds = np.bitwise_or.reduceat(_KIND[buf], np.stack([words.start, words.end], axis=1).reshape(-1)[: 2 * len(words.id) - (words.end[-1] == n)])[::2].astype(np.int64)
        owner = words.doc_of_word()
        repeat = np.zeros(len(owner), dtype=np.int64)
        repeat[1:] = (words.id[1:] == words.id[:-1]) & (owner[1:] == owner[:-1])
        size = np.minimum((words.end - words.start) // 3, 3)
        slot = kinds + 64 * repeat + 128 * size
        out[:, TRIGRAMS:] = np.bincount(owner * SHAPES + slot, minlength=docs * SHAPES).reshape(docs, SHAPES)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float64)
        if not len(labels):
            return
        self.weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
        x = self.weighted(counts)
        rank = min(RANK, *x.shape)
        q = np.linalg.qr(x.T @ np.random.default_rng(0).standard_normal((len(x), rank + 8)).astype(np.float32))[0]
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        self.basis = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :rank].astype(np.float32)
        self.points = _unit(x @ self.basis)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """Square roots of shares, each half (trigrams, word features) with the same mass, times the weights."""
        parts = [counts[:, :TRIGRAMS], counts[:, TRIGRAMS:]]
        share = np.concatenate([p / np.maximum(p.sum(axis=1, keepdims=True), 1) for p in parts], axis=1)
        return _unit(np.sqrt(share) * self.weight)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.zeros(len(counts))
        out = np.zeros(len(counts))
        k = min(NEIGHBOURS, len(self.labels))
        for low in range(0, len(counts), BLOCK):
            part = counts[low : low + BLOCK]
            cos = _unit(self.weighted(part) @ self.basis) @ self.points.T
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(part), 1))
            weight = np.maximum(np.take_along_axis(cos, near, axis=1).astype(np.float64), 0) ** 8
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
            out[low : low + BLOCK] = np.where(part.sum(axis=1) > 0, np.where(total > 1e-9, vote, self.labels.mean()), 0.0)
        return np.clip(out, 0.0, 1.0)


_FEATURE_ROWS = pa.schema([("rank", pa.int64()), ("label", pa.int32()), ("counts", pa.binary())])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.slices(batch):
            x = features(*textops.utf8(textops.text_column(part)))
            yield textops.batch_of(_FEATURE_ROWS, part.column(1).cast(pa.int64()), part.column(2).cast(pa.int32()), [r.tobytes() for r in x])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The latent space and its labelled points, from about `sample` labelled rows that aren't held out."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"), F.lit(1).alias("all"))
    few = textops.bounded_sample(rows, "all", ["doc_id", "label"], sample).select("doc_id", "rank", "label")  # a bounded number of rows: it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "rank", "label").agg(F.min("text").alias("text"))  # one text, if many rows have an id
    texts = texts.select("text", "rank", "label")
    got = sorted((r["rank"], r.label, bytes(r.counts)) for r in texts.mapInArrow(_feature_rows, "rank long, label int, counts binary").collect())
    counts = np.frombuffer(b"".join(x[2] for x in got), dtype=np.float32).reshape(-1, FEATURES)
    return Model(counts, np.array([x[1] for x in got], dtype=np.int64))


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """held_out, score and predicted of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels))  # SAMPLE x RANK and FEATURES x RANK numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch):
                s = sent.value.scores(features(*textops.utf8(textops.text_column(part))))
                yield textops.batch_of(_RESULT, part.column(0).cast(pa.int64()), part.column(2), s, (s >= THRESHOLD).astype(np.int32))

    return textops.narrow(docs, "doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
