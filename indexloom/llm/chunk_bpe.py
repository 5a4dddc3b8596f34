"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over a few bytes cuts every text at places that depend on the bytes around them
only, so copied passages give the same chunks wherever they stand. Of each chunk, what lies between
its first and its last white space (its body) is encoded once and kept for the worker's later texts:
by the library, or, for vocabularies of words (see `wordcode`), from a memory of the library's ids
of words, in half the time. What straddles a cut (a join) is encoded anew, as a whole; then a window one
word wider on both sides is encoded, and the join stands if that gives the very same ids. Else the
window grows until it agrees, and the document is put together from its windows and the texts
between them. Joins and windows are always the library's, and nothing is assumed there of how the
vocabulary splits texts.

Nulls and empty texts give no ids. Repeated rows and ties give equal results, row by row. Extra
columns are left out, whatever their names. A text of any length is encoded whole. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from indexloom.llm import textops
from indexloom.llm.wordcode import WordCoder, coder, library, public_path, splits_words

WINDOW = 16  # bytes of the rolling hash, a power of two
MASK_BITS = 11  # a cut each 2048 bytes on average
KEPT_CHUNK_IDS = 2_000_000  # ids of chunks that a worker keeps; emptied beyond
KEPT_WORDS = 50_000  # words beside joins whose ids a worker keeps; emptied beyond
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x0A]] = True

_COUNTS = ("n_chunks", "n_reused", "n_joins", "n_repaired", "n_grown")
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string, " + ", ".join(f"{c} long" for c in _COUNTS)
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *((c, pa.int64()) for c in _COUNTS)])


def cut_points(buf: np.ndarray, window: int = WINDOW, bits: int = MASK_BITS) -> np.ndarray:
    """Byte positions where the rolling hash of the `window` bytes before them ends in `bits` zeros."""
    n = len(buf)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    rolled = buf.astype(np.uint64) + np.uint64(1)
    span, factor = 1, textops.powers(window + 1)
    while span < window:  # sums over 2, 4, 8 ... bytes, each from two of half the length
        rolled = rolled[:-span] + rolled[span:] * factor[span]
        span *= 2
    rolled = textops.mix(rolled)
    return np.flatnonzero((rolled & np.uint64((1 << bits) - 1)) == 0) + window


class ChunkEncoder:
    """Encodes texts by chunks, whatever the tokenizer; one for each worker (`encoder`)."""

    def __init__(self, tok, bits: int = MASK_BITS, words: WordCoder | None = None):
        self.tok, self.bits, self.words = tok, bits, words
        self.kept: dict[bytes, np.ndarray] = {}
        self.kept_ids = 0
        self.near: dict[str, list[int]] = {"": []}
        size = tok.get_vocab_size()
        self.token_text = pa.array([tok.id_to_token(i) or "" for i in range(size)], type=pa.string())

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _bodies(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if self.words is None:
            yield from (np.array(x, dtype=np.int32) for x in self._batch([t.decode() for t in texts]))
        elif texts:
            ids, at = self.words.encode(pa.array(texts, type=pa.large_binary()).cast(pa.large_string()))
            yield from (ids[a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True))

    def _learn(self, texts: list[str]) -> None:
        """Learns the ids of the texts beside joins."""
        if len(self.near) > KEPT_WORDS:
            self.near = {"": []}
        new = sorted(set(texts).difference(self.near))
        self.near.update(zip(new, self._batch(new), strict=True))

    def _grow(self, raw: bytes, low: int, high: int, left: int, right: int) -> tuple[int, int, list[int]]:
        """Ids of raw[low:high], where low and high touch white space or a text's ends; grows them until a wider window agrees."""
        while True:
            ids = self._ids(raw[low:high].decode())
            wide_low, wide_high = _step_left(raw, low, left), _step_right(raw, high, right)
            if self._ids(raw[wide_low:wide_high].decode()) == self._ids(raw[wide_low:low].decode()) + ids + self._ids(raw[high:wide_high].decode()):
                return low, high, ids
            low, high = wide_low, wide_high

    def _mended(self, raw: bytes, left: int, right: int, windows: list[tuple[int, int]]) -> list[int]:
        """Ids of a document some of whose windows disagree: these are grown until they and the rest agree."""
        while True:
            grown = sorted(self._grow(raw, a, b, left, right)[:2] for a, b in windows)
            merged: list[list[int]] = []
            for a, b in grown:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            if [tuple(m) for m in merged] == sorted(windows):
                break
            windows = [tuple(m) for m in merged]  # fused windows have to agree with what is around them too
        out, at = [], left
        for a, b in windows:
            out += self._ids(raw[at:a].decode()) + self._ids(raw[a:b].decode())
            at = b
        return out + self._ids(raw[at:right].decode())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """ids, offsets, and per text the numbers of chunk bodies, of reused ones, of joins, of joins whose ids differ from those of the parts alone, and of windows that had to grow."""
        buf, offsets = textops.utf8(texts)
        docs = len(texts)
        cuts = np.setdiff1d(cut_points(buf, bits=self.bits), offsets)
        cuts = cuts[(buf[cuts] & 0xC0) != 0x80] if len(cuts) else cuts  # within a character nothing is cut
        space = np.flatnonzero(_SPACE[buf]) if len(buf) else np.zeros(0, np.int64)
        # around each cut: the last white space before it and the first at or after it, within the document
        doc = np.searchsorted(offsets, cuts, side="right") - 1
        i = np.searchsorted(space, cuts)
        before = np.where(i > 0, space[np.maximum(i - 1, 0)] if space.size else 0, -1)
        after = np.where(i < space.size, space[np.minimum(i, max(space.size - 1, 0))] if space.size else 0, len(buf))
        low = np.maximum(before, offsets[doc])
        high = np.minimum(after, offsets[doc + 1])
        # joins that touch or overlap are one join; the rest of a document are bodies
        edges = np.unique(np.concatenate([offsets[:-1], offsets[1:], low, high]))
        inner = np.zeros(len(edges) + 1, dtype=np.int64)
        np.add.at(inner, np.searchsorted(edges, low), 1)
        np.add.at(inner, np.searchsorted(edges, high), -1)
        is_join = np.cumsum(inner)[: len(edges) - 1] > 0
        starts, ends = edges[:-1], edges[1:]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        if len(starts):
            fuse = np.zeros(len(starts), dtype=bool)
            fuse[1:] = is_join[1:] & is_join[:-1] & (owner[1:] == owner[:-1])
            head = np.flatnonzero(~fuse)
            ends = ends[np.concatenate([head[1:] - 1, [len(starts) - 1]])]
            starts, is_join, owner = starts[head], is_join[head], owner[head]
        raw = buf.tobytes()
        ids: list[np.ndarray | list[int]] = [[]] * len(starts)
        reused = np.zeros(len(starts), dtype=bool)

        bodies = [raw[a:b] for a, b in zip(starts[~is_join].tolist(), ends[~is_join].tolist(), strict=True)]
        fresh = [x for x in dict.fromkeys(bodies) if x not in self.kept]
        if self.kept_ids > KEPT_CHUNK_IDS:
            self.kept, self.kept_ids, fresh = {}, 0, list(dict.fromkeys(bodies))
        first = set(fresh)
        for x, got in zip(fresh, self._bodies(fresh), strict=True):
            self.kept[x] = got
            self.kept_ids += len(got)
        for k, x in zip(np.flatnonzero(~is_join).tolist(), bodies, strict=True):
            ids[k], reused[k] = self.kept[x], x not in first
            first.discard(x)

        joins = np.flatnonzero(is_join).tolist()
        repaired, grown, mended = np.zeros(len(starts), dtype=bool), np.zeros(len(starts), dtype=bool), {}
        if joins:
            spans = [(int(starts[k]), int(ends[k]), int(offsets[owner[k]]), int(offsets[owner[k] + 1])) for k in joins]
            wide = [(_step_left(raw, a, left), _step_right(raw, b, right)) for a, b, left, right in spans]
            text = lambda a, b: raw[a:b].decode()
            cut_in = np.searchsorted(cuts, starts[joins]), np.searchsorted(cuts, ends[joins])
            seams = [[a, *cuts[x:y].tolist(), b] for (a, b, *_), x, y in zip(spans, *cut_in, strict=True)]
            parts = [[text(x, y) for x, y in zip(s[:-1], s[1:], strict=True)] for s in seams]
            self._learn([t for (a, b, *_), (c, d) in zip(spans, wide, strict=True) for t in (text(c, a), text(a, b), text(b, d))] + [t for p in parts for t in p])
            whole = self._batch([text(c, d) for c, d in wide])
            for k, (a, b, *_), (c, d), p, w in zip(joins, spans, wide, parts, whole, strict=True):
                ids[k] = self.near[text(a, b)]
                repaired[k] = ids[k] != [t for x in p for t in self.near[x]]
                grown[k] = w != self.near[text(c, a)] + ids[k] + self.near[text(b, d)]
            for d in sorted({int(owner[k]) for k in joins if grown[k]}):
                mine = [k for k in joins if owner[k] == d]
                mended[d] = self._mended(raw, int(offsets[d]), int(offsets[d + 1]), [(int(starts[k]), int(ends[k])) for k in mine])
        at = np.searchsorted(owner, np.arange(docs + 1))
        per_doc = [[np.array(mended[d], dtype=np.int32)] if d in mended else [np.asarray(x, dtype=np.int32) for x in ids[at[d] : at[d + 1]]] for d in range(docs)]
        flat = [x for xs in per_doc for x in xs]
        lengths = np.array([sum(map(len, xs)) for xs in per_doc], dtype=np.int64)
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
        numbers = dict(zip(_COUNTS, (count(~is_join), count(reused), count(is_join), count(repaired), count(grown)), strict=True))
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(lengths)]), numbers

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The library's decode() of each range of ids. Without a decoder of its own it joins tokens by a space, which columns do faster."""
        if self.tok.decoder is None:
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), self.token_text.take(pa.array(ids, type=pa.int64()))), " ")
        return pa.array(self.tok.decode_batch([ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], skip_special_tokens=False), type=pa.string())


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker and vocabulary: chunks are shared by all the texts that it reads."""
    return ChunkEncoder(library(path), words=coder(path) if splits_words(path) else None)


def _step_left(raw: bytes, at: int, least: int) -> int:
    """The start of the word before `at` (its white space included), not before `least`."""
    i = at
    while i > least and raw[i - 1] in b" \n":
        i -= 1
    return max(least, raw.rfind(b" ", least, i), raw.rfind(b"\n", least, i))


def _step_right(raw: bytes, at: int, most: int) -> int:
    i = at
    while i < most and raw[i] in b" \n":
        i += 1
    ends = [x for x in (raw.find(b" ", i, most), raw.find(b"\n", i, most)) if x >= 0]
    return min(ends, default=most)


def _task(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = encoder(path)
        for batch in batches:
            for part in textops.slices(batch, limit=2_000_000):
                ids, at, numbers = chunks.encode(textops.text_column(part))
                decoded = chunks.decode(ids, at)
                raw = ids.astype("<u4")
                keys = part.column(0).cast(pa.int64())
                rows = range(len(at) - 1)
                if digest:
                    yield textops.batch_of(_DIGEST, keys, np.diff(at), [hashlib.sha256(raw[at[i] : at[i + 1]].tobytes()).hexdigest() for i in rows], [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded], *numbers.values())
                else:
                    yield textops.batch_of(_ARROW, keys, np.diff(at), [raw[at[i] : at[i + 1]].tobytes() for i in rows], decoded.cast(pa.string()), *numbers.values())

    return run


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded text and chunk counts of every row of docs (doc_id, text)."""
    return textops.narrow(docs, "doc_id", "text").mapInArrow(_task(path or public_path(), False), SCHEMA)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The same with SHA-256 digests in place of ids and text."""
    return textops.narrow(docs, "doc_id", "text").mapInArrow(_task(path or public_path(), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, " + ", ".join(f"{c} long" for c in _COUNTS))
