"""Exact encoding and decoding with a public BPE vocabulary, each distinct word encoded once per task.

White space never belongs to a token of this vocabulary: the vocabulary's own splitting rule drops
it, its normalisation does not look across it, and its special tokens hold none. So the ids of a
text are the ids of its white-space separated words, one after another, and the library has to be
asked only about words that the worker hasn't met.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from indexloom.llm import textops

CACHE_WORDS = 250_000  # a worker's memory of words is emptied beyond this number; results don't depend on it


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(len(x), size - len(x)), dtype=x.dtype)])


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(2)
def splits_words(path: str) -> bool:
    """Do this vocabulary's tokens keep within words, by its own ending for words and a splitting rule that drops white space?"""
    tok = library(path)
    if tok.pre_tokenizer is None or getattr(tok.model, "end_of_word_suffix", None) != "</w>":
        return False
    return tok.encode("a b", add_special_tokens=False).ids == tok.encode(" a \n b ", add_special_tokens=False).ids and not any(set(" \t\n\r\v\f") & set(t) for t in tok.get_vocab())


@lru_cache(2)
def classes(path: str) -> np.ndarray:
    """Per byte 1 for a lower-case letter, 2 for a digit, 3 for a mark, 0 for all else: where two of these meet, this vocabulary splits.

    Marks are the ASCII ones that the library itself is seen to split from letters and digits, on both
    sides and before the ends of contractions; the apostrophe is none.
    """
    tok, kind = library(path), np.zeros(256, dtype=np.uint8)
    same = lambda a, b: tok.encode(a, add_special_tokens=False).ids == tok.encode(b, add_special_tokens=False).ids
    if not same("aBc Zz", "abc zz") or not same("ab12cd3", "ab 12 cd 3"):
        return kind
    kind[0x61:0x7B], kind[0x30:0x3A] = 1, 2
    for c in string.punctuation:
        around = [(f"{x}{c}{y}", f"{x} {c} {y}") for x in ("ab", "7", "") for y in ("cd", "s", "ll", "7", "")]
        twice = [(f"ab{c}{c}s", f"ab {c}{c} s"), (f"ab{c}'s", f"ab {c}'s"), (f"ab'{c}s", f"ab'{c} s")]
        if c != "'" and all(same(x, y) for x, y in around + twice):
            kind[ord(c)] = 3
    return kind


_LETTERS = r"^[a-zß-öø-ÿ]+$"
_ASK = 20_000  # words that the library is asked about at once


class WordCoder:
    """Remembers the ids of words; the library is asked about new words only.

    ASCII letters are lower-cased and spaces put between letters, digits and marks first, as the
    vocabulary itself lower-cases and splits there, so a word with a capital or a full stop isn't
    another word. Documents that hold a special token, in whatever case, are taken as they are.
    """

    def __init__(self, path: str, most_words: int = CACHE_WORDS):
        self.most_words = most_words
        self.tok = library(path)
        self.by_words = splits_words(path)
        self.kind = classes(path)
        self.special = sorted({t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()} - {b""})
        size = self.tok.get_vocab_size()
        strings = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.token_text = pa.array(strings, type=pa.string())
        self.ends_word = np.fromiter((t.endswith("</w>") for t in strings), dtype=bool, count=size)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.at = np.zeros(1 << 14, dtype=np.int32)
        self.length = np.zeros(1 << 14, dtype=np.int32)

    def _library_ids(self, part: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words. Runs of letters end in one end-of-word token each, so many of them can be asked about as one text."""
        if letters:
            texts = [" ".join(part[k : k + 1000]) for k in range(0, len(part), 1000)]
            ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
            lengths = np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
            if len(lengths) == len(part) and int(lengths.sum()) == len(ids):
                return ids, lengths
        got = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(lengths.sum())), lengths

    def _learn(self, new: pa.Array) -> None:
        plain = pc.match_substring_regex(new, _LETTERS)
        for words, letters in ((new.filter(plain).to_pylist(), True), (new.filter(pc.invert(plain)).to_pylist(), False)):
            for k in range(0, len(words), _ASK):
                part = words[k : k + _ASK]
                ids, lengths = self._library_ids(part, letters)
                first, total = len(self.words), len(ids)
                self.pool = _grown(self.pool, self.used + total)
                self.at, self.length = _grown(self.at, first + len(part)), _grown(self.length, first + len(part))
                self.pool[self.used : self.used + total] = ids
                self.at[first : first + len(part)] = self.used + np.cumsum(lengths) - lengths
                self.length[first : first + len(part)] = lengths
                self.words.update(zip(part, range(first, first + len(part)), strict=True))
                self.used += total

    def _spaced(self, texts: pa.Array) -> pa.Array:
        """The texts in lower case with their words apart."""
        buf, offsets = textops.utf8(texts)
        if not len(buf) or not self.kind.any():
            return texts
        low = textops.lower_ascii(buf)
        kind = self.kind[low]
        meet = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        raw = low.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, side="right")) - 1
                start, end = int(offsets[doc]), int(offsets[doc + 1])
                low[start:end] = buf[start:end]
                meet[max(start - 1, 0) : end] = False
                at = raw.find(token, end)
        cuts = np.flatnonzero(meet) + 1
        low = np.insert(low, cuts, 0x20)
        offsets = offsets + np.searchsorted(cuts, offsets)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(low))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of large_string texts without nulls. A vocabulary whose tokens cross words is left to the library alone."""
        if not self.by_words:
            ids, lengths = self._library_ids(texts.to_pylist(), False)
            return ids, np.concatenate([[0], np.cumsum(lengths)])
        split = pc.ascii_split_whitespace(self._spaced(texts))
        coded = split.values.dictionary_encode()
        row = split.offsets.to_numpy()
        if len(self.words) > self.most_words:
            self.forget()
        values = coded.dictionary.to_pylist()
        slots = list(map(self.words.get, values))
        new = [k for k, x in enumerate(slots) if x is None]
        if new:
            self._learn(coded.dictionary.take(pa.array(new, type=pa.int64())))
            for k in new:
                slots[k] = self.words[values[k]]
        del values
        word = np.array(slots, dtype=np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.length[word]
        ends = np.zeros(len(word) + 1, dtype=np.int64)
        np.cumsum(lengths, out=ends[1:])
        # 32-bit places do: neither a slice's ids nor the pool come near 2**31
        place = np.repeat(self.at[word] - ends[:-1].astype(np.int32), lengths)
        place += np.arange(ends[-1], dtype=np.int32)
        return self.pool[place], ends[row - row[0]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The library's decode() of each range of ids: this vocabulary has no decoder, so tokens are joined by a space."""
        tokens = self.token_text.take(pa.array(ids, type=pa.int64()))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), tokens), " ")


@lru_cache(2)
def coder(path: str, most_words: int = CACHE_WORDS) -> WordCoder:
    """One coder for each Python worker and vocabulary."""
    return WordCoder(path, most_words)
