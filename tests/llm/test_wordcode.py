"""Words by memory against the library, text by text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from indexloom.llm.wordcode import WordCoder, classes, public_path

ATOMS = [
    *"abcxyzABCXYZ", *"0123456789", *"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", *"éÉßÀ÷×Σςİıſÿ", "́", "̸", "⃣", "👍🏽", "日本", "K", "½", "²", "٣",
    " ", " ", " ", "\n", "\t", "\r", "\x0b", "\x0c", " ", " ", " ", "\u0085", "​", "\x00",
    "'s", "'S", "'t", "'re", "'LL", "'d", "don't", "The", "the", "End.", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>",
]


def fuzz(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ATOMS) for _ in range(r.choice([0, 1, 2, 3, 8, 40, 200]))) for _ in range(n)]


def equal(coder, texts):
    got, at = coder.encode(pa.array(texts, type=pa.large_string()))
    want = [e.ids for e in coder.tok.encode_batch_fast(texts, add_special_tokens=False)]
    for k, t in enumerate(texts):
        assert got[at[k] : at[k + 1]].tolist() == want[k], repr(t)
    assert len(at) == len(texts) + 1 and at[-1] == len(got)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_library(seed):
    equal(WordCoder(public_path()), fuzz(seed, 3000))


def test_every_boundary_of_two_and_three():
    texts = [a + b for a in ATOMS for b in ATOMS] + [x + b + y for b in ATOMS for x in ("a", "7", ".", "'", "é") for y in ("s", "ll", "7", "*", "'", "̸")]
    equal(WordCoder(public_path()), texts)


def test_a_memory_that_overflows_forgets_and_stays_right():
    coder = WordCoder(public_path(), most_words=50)
    for seed in range(20):
        equal(coder, fuzz(seed, 40))


def test_no_texts_and_empty_ones():
    coder = WordCoder(public_path())
    for texts in ([], [""], ["", " \n", ""], ["<|endoftext|>", "", "A.b"]):
        equal(coder, texts)


def test_marks_are_those_that_the_vocabulary_splits():
    kind = classes(public_path())
    assert kind[ord("'")] == 0 and kind[ord(".")] == 3 and kind[ord("a")] == 1 and kind[ord("7")] == 2 and not kind[0x80:].any() and not kind[ord("A")]


def test_other_vocabularies_are_left_to_the_library():
    import public_tokenizers

    coder = WordCoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not coder.by_words
    equal(coder, fuzz(9, 200))


def test_a_slice_of_an_array():
    texts = fuzz(3, 60)
    coder = WordCoder(public_path())
    got, at = coder.encode(pa.array(texts, type=pa.large_string()).slice(20, 30))
    want, _ = coder.encode(pa.array(texts[20:50], type=pa.large_string()))
    assert np.array_equal(got, want) and len(at) == 31
