"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes is grown from a bounded sample of its
labelled documents and then frozen: the empty context, all one-byte contexts seen, the most frequent
two-byte contexts and, below those, the three-byte contexts that occur at least MIN_COUNT times, up
to CONTEXTS for each language, however many languages there are. A tree keeps only what it has seen:
a context's bytes with their code lengths, and its escape. A byte's code length in a context is that
of its count there, or the escape's (method C: distinct successors over total plus distinct) plus
its code length one byte shorter; the empty context escapes to 256 equal bytes. Under frozen
statistics this depends on the context and the byte alone, so a slice's distinct runs of four
bytes are looked up once in each tree, and a text's exact code length is the sum over all its bytes.

Texts are lower-cased, digits become 0. Null texts and texts without a letter are `und` with score
0. Ties go to the language that sorts first. Repeated rows are learnt as often as the sample holds
them. Rows without a language or text are not learnt. With nothing to learn every text is `und`.
Extra columns are left out, whatever their names. Texts are scored whole. An empty table gives an
empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm import textops

SAMPLE_DOCS = 400  # labelled documents of a language that the trees are grown from, in the mean
SAMPLE_CHARS = 20_000  # drawn documents are learnt whole up to this length, longer ones in windows of this size together
WINDOWS = 8  # spread evenly over a long document
MIN_COUNT = 4
CONTEXTS = 20_000  # of a language; a tree of so many takes about a MB, and goes to every worker

_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x30:0x3A] = 0x30


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3 is 1; a row without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = textops.utf8(pc.utf8_lower(texts))
    return _FOLD[buf], offsets


class Tree:
    """One language's contexts of one to three bytes, and what it has seen after each."""

    def __init__(self, samples: list[str]):
        buf, offsets = folded(pa.array(samples, type=pa.large_string()))
        grams = [self._count(buf, offsets, n) for n in range(1, 5)]
        self.empty = np.full(256, 8.0)
        if len(grams[0][0]):
            total, distinct = grams[0][1].sum(), len(grams[0][0])
            self.empty += np.log2((total + distinct) / distinct)
            self.empty[grams[0][0]] = np.log2((total + distinct) / grams[0][1])
        one = np.unique(grams[1][0] >> 8)
        two = np.sort(self._frequent(grams[2], 1)[: CONTEXTS // 2])
        deep = self._frequent(grams[3], MIN_COUNT)
        three = np.sort(deep[np.isin(deep & 0xFFFF, two)][: max(0, CONTEXTS - len(one) - len(two))])
        self.contexts = [one, two, three]
        self.levels = [self._level(c, g) for c, g in zip(self.contexts, grams[1:], strict=True)]

    @staticmethod
    def _count(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams as integers (oldest byte highest) with their counts; none crosses a document's end."""
        if len(buf) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = len(buf) - n + 1
        code = np.zeros(k, dtype=np.int64)
        for i in range(n):
            code = code << 8 | buf[i : i + k]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        return np.unique(code[doc[:k] == doc[n - 1 :]], return_counts=True)

    @staticmethod
    def _frequent(gram: tuple[np.ndarray, np.ndarray], least: int) -> np.ndarray:
        """Contexts (all but the last byte of the grams), the most frequent first."""
        context, inverse = np.unique(gram[0] >> 8, return_inverse=True)
        total = np.bincount(inverse, weights=gram[1], minlength=len(context))
        order = np.lexsort((context, -total))
        return context[order[total[order] >= least]]

    @staticmethod
    def _level(contexts: np.ndarray, gram: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(escape of each context, runs of context and byte that were seen, their code lengths)."""
        mine = np.isin(gram[0] >> 8, contexts)
        run, count = gram[0][mine], gram[1][mine]
        at = np.searchsorted(contexts, run >> 8)
        total, distinct = np.bincount(at, weights=count, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
        return np.log2((total + distinct) / np.maximum(distinct, 1)).astype(np.float32), run.astype(np.uint32), np.log2((total + distinct)[at] / count).astype(np.float32)

    def cost(self, codes: np.ndarray, order: int = 3) -> np.ndarray:
        """Code lengths in bits of the lowest byte of each code (ascending) behind its `order` higher bytes."""
        out = self.empty[codes & 0xFF]
        for k in range(order):
            contexts, (escape, runs, cost) = self.contexts[k], self.levels[k]
            if len(contexts):
                run = codes & ((1 << 8 * (k + 2)) - 1)
                at = np.minimum(np.searchsorted(contexts, run >> 8), len(contexts) - 1)
                known = contexts[at] == run >> 8
                place = np.minimum(np.searchsorted(runs, run), len(runs) - 1)
                out = np.where(known, np.where(runs[place] == run, cost[place], escape[at] + out), out)
        return out


class Model:
    """Frozen trees of all languages."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[k] for k in self.langs]

    def bits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length of each document for each language; contexts don't reach across documents."""
        docs, n = len(offsets) - 1, len(buf)
        out = np.zeros((docs, len(self.langs)))
        if not n:
            return out
        code = buf.astype(np.uint32)
        for k in range(1, 4):
            code[k:] |= buf[:-k].astype(np.uint32) << np.uint32(8 * k)
        place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
        parts = []  # positions, what stands there once each, which of it stands at each position, bytes of context
        for order in range(4):
            at = np.flatnonzero(place == order) if order < 3 else np.flatnonzero(place >= 3)
            distinct, inverse = np.unique(code[at] & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            parts.append((at, distinct.astype(np.int64), inverse, order))
        full = np.flatnonzero(np.diff(offsets))
        costs = np.empty(n, dtype=np.float32)
        for lang, tree in enumerate(self.trees):
            for at, distinct, inverse, order in parts:
                costs[at] = tree.cost(distinct, order).astype(np.float32)[inverse]
            out[full, lang] = np.add.reduceat(costs, offsets[:-1][full], dtype=np.float64)
        return out


def _windows(sample_chars: int) -> Column:
    """The text in an array, or, if it is longer than sample_chars, windows from its start to its end."""
    n, size = F.length("text"), max(1, sample_chars // WINDOWS)
    start = lambda i: F.floor(i * (n - size) / (WINDOWS - 1)).cast("int") + 1
    return F.when(n <= sample_chars, F.array("text")).otherwise(F.array(*(F.substring("text", start(F.lit(i)), F.lit(size)) for i in range(WINDOWS))))


def _grown(group: pd.DataFrame) -> pd.DataFrame:
    """One language's sample becomes its tree."""
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "tree": [pickle.dumps(Tree([t for texts in group["texts"] for t in texts]))]})


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Grows the trees from about sample_docs documents of each language (twice that at most), whatever their lengths, and at most sample_chars characters of each; a task grows a language's."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out()).select("doc_id", "lang", "text")
    few = textops.bounded_sample(rows, "lang", ["doc_id", "text"], sample_docs).select("lang", _windows(sample_chars).alias("texts"))
    return Model({r.lang: pickle.loads(r.tree) for r in few.groupBy("lang").applyInPandas(_grown, "lang string, tree binary").collect()})


def _predict(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for part in textops.slices(batch):
                texts = textops.text_column(part)
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                keys, out = part.column(0).cast(pa.int64()), part.column(2).to_pylist()
                n = len(texts)
                if not m.langs:
                    yield textops.batch_of(_RESULT, keys, out, ["und"] * n, np.zeros(n), [None] * n)
                    continue
                buf, offsets = folded(texts)
                bits = m.bits(buf, offsets)
                size = np.maximum(np.diff(offsets), 1)
                best = bits.argmin(axis=1)
                gap = (bits - bits[np.arange(n), best][:, None]) / np.sqrt(size)[:, None]
                score = np.where(letters, 1 / np.exp2(-np.minimum(gap, 60.0)).sum(axis=1), 0.0)
                yield textops.batch_of(_RESULT, keys, out, [m.langs[b] if x else "und" for b, x in zip(best, letters, strict=True)], score, bits[np.arange(n), best] / size)

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """lang_pred and score of every row of docs (doc_id, text, lang); the trees come from docs itself unless given."""
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs))  # about a MB for each language
    return textops.narrow(docs, "doc_id", "text", held_out().alias("held_out")).mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
