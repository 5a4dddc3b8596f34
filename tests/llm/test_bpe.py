import hashlib
import zlib

import cases
import numpy as np
import pytest
from tokenizers import Tokenizer

from indexloom.llm import chunk_bpe, plane_files, textops
from indexloom.llm.wordcode import public_path


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_path())


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("make", [cases.documents, cases.sample, cases.empty])
def test_op9_equals_library(spark, tok, make):
    docs = make(spark)
    want = []
    for r in docs.select("doc_id", "text").collect():
        x = ids(tok, r.text)
        want.append((r.doc_id, len(x), hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(x, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r)[:4] for r in chunk_bpe.encode_digests(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_chunks_are_reused_and_joins_repaired(spark):
    text = " ".join("".join(chr(97 + (i * i * k) % 26) for k in range(1, 3 + i % 9)) for i in range(9000))
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").coalesce(1)
    rows = chunk_bpe.encode_decode(docs).collect()
    assert 3 < rows[0].n_repaired <= rows[0].n_joins and rows[0].n_grown == 0 and all(r.n_reused == r.n_chunks for r in rows[1:])
    assert len({bytes(r.ids) for r in rows}) == 1


def test_an_encoder_serves_all_tasks_of_a_worker():
    assert chunk_bpe.encoder(public_path()) is chunk_bpe.encoder(public_path())


def across_spaces():
    """A vocabulary made by hand, without any splitting: its tokens cross spaces, so chunks, joins and windows do disagree."""
    from tokenizers.models import BPE

    merges = ["a b", "ab ␣", "ab␣ c", "c d", "cd ␣", "cd␣ ab␣", "b ␣", "␣ ␣", "d a", "da b", "cd␣ab␣ cd␣", "ab␣c d"]
    merges = [tuple(m.split(" ")) for m in merges]
    letters = ["a", "b", "c", "d", "e", "␣"]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(letters + ["".join(m) for m in merges]))}
    real = lambda t: t.replace("␣", " ")
    return Tokenizer(BPE({real(t): i for t, i in vocab.items()}, [(real(x), real(y)) for x, y in merges]))


def test_bodies_by_the_library_alone_give_the_same():
    import pyarrow as pa

    tok = Tokenizer.from_file(public_path())
    texts = pa.array([t or "" for t in cases.TEXTS] * 2, type=pa.large_string())
    a, b = chunk_bpe.ChunkEncoder(tok, bits=5).encode(texts), chunk_bpe.encoder(public_path()).encode(texts)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and chunk_bpe.encoder(public_path()).words is not None
    assert a[2]["n_joins"].sum() > 10


def test_windows_grow_until_they_agree():
    import random

    import pyarrow as pa

    tok, r = across_spaces(), random.Random(2)
    encoder = chunk_bpe.ChunkEncoder(tok, bits=3)
    texts = ["".join(r.choice(["ab", "cd", "abcd", "da", "e", "dab"]) + r.choice([" ", " ", "  ", ""]) for _ in range(r.randint(0, 120))) for _ in range(60)]
    got, at, numbers = encoder.encode(pa.array(texts, type=pa.large_string()))
    for k, t in enumerate(texts):
        assert got[at[k] : at[k + 1]].tolist() == ids(tok, t)
    assert numbers["n_grown"].sum() > 20 and numbers["n_repaired"].sum() > 20 and numbers["n_joins"].sum() > numbers["n_grown"].sum()


def test_a_window_that_agrees_stays():
    enc = chunk_bpe.encoder(public_path())
    raw = b"one two three"
    low, high, got = enc._grow(raw, 4, 7, 0, len(raw))
    assert (low, high) == (4, 7) and got == enc._ids("two")


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_plane_file_round_trip(bits, n):
    x = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
    image = plane_files.write_file(x, block=64, bits=bits)
    assert (plane_files.read_file(image) == x).all()
    assert (plane_files.read_file(image, 3, 70) == x[3:70]).all()
    with pytest.raises(ValueError):
        plane_files.read_file(b"????" + image[4:])


@pytest.mark.parametrize("make", [cases.documents, cases.sample, cases.empty])
@pytest.mark.parametrize("bits", [False, True])
def test_op2_reads_back_what_was_written(spark, tok, make, bits):
    docs = make(spark)
    folder = textops.shared_dir(spark, "t")
    plane_files.write_ids(docs, folder, bits=bits, block=100, segment=5000)
    got = sorted(map(tuple, plane_files.read_digests(spark, folder).collect()), key=lambda r: r[1])
    rows = docs.select("doc_id", "text").collect()
    assert [r[0] for r in got] == sorted((r.doc_id for r in rows), key=lambda k: (k is not None, k or 0))
    want = sorted((r.doc_id, zlib.crc32(np.asarray(ids(tok, r.text) + [2], "<u4").tobytes())) for r in rows if r.doc_id is not None)
    assert sorted((r[0], r[3]) for r in got if r[0] is not None) == want
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    back = {(r.doc_id, tuple(r.ids)) for r in plane_files.read_ids(spark, folder).collect()}
    assert back == {(r.doc_id, tuple(ids(tok, r.text) + [2])) for r in rows}
