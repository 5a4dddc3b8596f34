"""Phrase collocations: exact counts of phrases and of their parts, each language on its own.

Texts are cut into pieces; identical pieces become one with a multiplicity. Tasks turn slices of pieces into
n-grams with summed multiplicities, which are dealt to hash buckets, a compressed row for each slice and bucket; in every bucket duckdb adds
them up from a stream, out of core where they don't fit (MEMORY; what it spills lies in the task's own folder and goes with the
task, as Spark's own spill does). Only phrases of LEAST occurrences leave a bucket. A candidate's parts
and the shorter candidates inside it lie in other buckets: it sends requests for them, shuffled to
the part's key, where they meet its count and go back; a common part is asked for by many, and
its requests can be split while its one count goes to each share.

Case A-Z is lowered, other letters stay. A null text is empty, a null language is ``und``, and both
give what they have: nothing, or a language of its own. Repeated rows count as often as they come.
Texts without words, and languages without candidates, give no rows. Pieces are taken whole, however
long. Ties are settled as the order of the results says: score, occurrences, phrase by its bytes; of
equal cuts the first. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.llm import textops

LONGEST = 3  # words of a phrase, at most
LEAST = 10  # occurrences of a candidate, at least
SHARE = 50  # a phrase inside a longer candidate with so many hundredths of its occurrences goes
TOP = 2000
MEMORY = "256MB"  # of duckdb in a task
SLICE = 4_000_000  # bytes of pieces whose n-grams are summed at once
BUCKETS = 4  # for each shuffle partition
LEVELS = (256, 16, 1)  # the first TOP of each language are found in so many parts, one level after another

_CUT = np.zeros(256, dtype=bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09]] = True
_PIECE = pa.schema([("lang", pa.large_string()), ("piece", pa.large_string()), ("n", pa.int64())])
_PACKED = pa.schema([("bucket", pa.int32()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("phrases", pa.binary()), ("sums", pa.binary())])
_GRAM = pa.schema([("lang", pa.large_string()), ("phrase", pa.large_string()), ("n", pa.int64())])
_COUNT = pa.schema([("lang", pa.large_string()), ("phrase", pa.large_string()), ("words", pa.int32()), ("n", pa.int64())])


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text, piece) of every piece with a word: A-Z lowered, its words joined by one space."""
    buf, offsets = textops.utf8(texts)
    buf = textops.lower_ascii(buf)
    cut, space = _CUT[buf], _SPACE[buf]
    word = ~cut & ~space
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offsets] = True
    start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | first[:-1]))
    end = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | first[1:])) + 1
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    text = np.searchsorted(offsets, start, side="right") - 1
    cuts = np.concatenate([[0], np.cumsum(cut)])
    # a word begins a piece if it is its text's first, or a cut lies between it and the word before
    begins = np.concatenate([[True], (cuts[start[1:]] > cuts[end[:-1]]) | (text[1:] != text[:-1])])
    length = end - start + 1  # with the space behind it
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.full(at[-1], 0x20, dtype=np.uint8)
    out[np.arange(at[-1]) - np.repeat(at[:-1], length) < np.repeat(length - 1, length)] = buf[word]
    piece = np.flatnonzero(begins)
    last = np.append(piece[1:], len(start))
    keep = np.ones(at[-1], dtype=bool)
    keep[at[last] - 1] = False  # no space at a piece's end
    bounds = np.append(at[piece], at[-1]) - np.arange(len(piece) + 1)
    return text[piece], pa.LargeStringArray.from_buffers(len(piece), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[keep]))


def _to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textops.slices(batch):
            text, piece = pieces_of(textops.text_column(part))
            lang = textops.text_column(part, "lang").take(pa.array(text))
            once = pa.table([lang, piece], names=["lang", "piece"]).group_by(["lang", "piece"]).aggregate([([], "count_all")])
            for b in once.rename_columns(_PIECE.names).cast(_PIECE).to_batches(textops.BATCH_ROWS):
                yield b


def _together(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about SLICE bytes of text: the more pieces at once, the more of their n-grams are the same."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(name)).nbytes
        if size >= SLICE:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The texts buf[start:end], which may overlap, each with a line feed behind it (no piece has one)."""
    length = end - start + 1
    at = np.cumsum(length)
    out = buf[np.minimum(np.arange(at[-1]) + np.repeat(start - at + length, length), len(buf) - 1)]
    out[at - 1] = 0x0A
    return out


def _to_grams(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches, "piece"):
            for part in textops.slices(batch, "piece", SLICE):
                yield from _packed(part, longest, buckets)

    return run


def _grams(part: pa.RecordBatch, longest: int):
    """(texts' bytes, languages, and of each different n-gram its language's place, its start, end, sum of multiplicities and hash).

    Each language's number of words comes as a phrase of no words.
    """
    lang = textops.text_column(part, "lang").dictionary_encode()
    names = lang.dictionary.cast(pa.large_string())
    language = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    times = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, offsets = textops.utf8(textops.text_column(part, "piece"))
    words = textops.Words(buf, offsets, ~_SPACE, lower=False)
    piece = words.doc_of_word()
    seed = textops.mix(textops.hashed(names.cast(pa.large_binary())))
    none = np.zeros(len(names), dtype=np.int64)
    total = none.copy()
    np.add.at(total, language[piece], times[piece])
    found = [(np.arange(len(names)), none, none, total, seed)]
    code = language[piece] * len(words.distinct) + words.id
    h = seed[language[piece]]
    for k in range(1, longest + 1):
        n = len(piece) - k + 1
        if n <= 0:
            break
        if k > 1:  # the run of k words from i on: that of k - 1 words from i on, and word i + k - 1
            code = code[:n] * len(words.distinct) + words.id[k - 1 :]
        h = textops.mix(h[:n] + words.hash[k - 1 :])
        whole = np.flatnonzero(piece[:n] == piece[k - 1 :])
        if not len(whole):
            break
        _, seen, same = np.unique(code[whole], return_index=True, return_inverse=True)
        sums = np.zeros(len(seen), dtype=np.int64)
        np.add.at(sums, same, times[piece[whole]])
        at = whole[seen]
        found.append((language[piece[at]], words.start[at], words.end[at + k - 1], sums, h[at]))
        if k > 1:  # small numbers again, so that the next product stays within 64 bits
            _, code = np.unique(code, return_inverse=True)
    return buf, names, *(np.concatenate(x) for x in zip(*found, strict=True))


def _packed(part: pa.RecordBatch, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of a slice, those of a bucket in one row: languages, how many phrases of each, phrases and sums, compressed."""
    buf, names, language, start, end, sums, h = _grams(part, longest)
    if not len(buf):
        return
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((language, bucket))
    bucket, language, start, end, sums = (x[order] for x in (bucket, language, start, end, sums))
    bounds = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    press = zstandard.ZstdCompressor(level=3)
    rows: list[tuple] = []
    held = 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        here = language[a:b]
        first = np.flatnonzero(np.diff(here, prepend=-1))
        rows.append((int(bucket[a]), names.take(pa.array(here[first])).to_pylist(), np.diff(np.append(first, b - a)).tolist(), press.compress(_joined(buf, start[a:b], end[a:b]).tobytes()), press.compress(sums[a:b].tobytes())))
        held += len(rows[-1][3])
        if held > textops.SLICE_BYTES or len(rows) >= textops.BATCH_ROWS:
            yield textops.batch_of(_PACKED, *zip(*rows, strict=True))
            rows, held = [], 0
    if rows:
        yield textops.batch_of(_PACKED, *zip(*rows, strict=True))


def _unpacked(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for langs, sizes, phrases, sums in zip(*(rows.column(k).to_pylist() for k in range(1, 5)), strict=True):
        data = press.decompress(phrases)
        ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x0A)
        raw = np.frombuffer(data, dtype=np.uint8)
        text = np.ones(len(raw), dtype=bool)
        text[ends] = False
        bounds = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int64)
        phrase = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(bounds), pa.py_buffer(raw[text]))
        lang = pa.array(langs, pa.large_string()).take(pa.array(np.repeat(np.arange(len(langs)), sizes)))
        yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.frombuffer(press.decompress(sums), dtype=np.int64))], schema=_GRAM)


def _count(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each bucket's n-grams; buckets come one after another, and duckdb reads each as a stream."""
        rows = (r for batch in batches for r in (batch.slice(i, 1) for i in range(batch.num_rows)))
        folder = tempfile.mkdtemp(prefix="collocations-")
        try:
            with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as con:
                for _, same in groupby(rows, key=lambda r: r.column(0)[0].as_py()):
                    bucket = pa.RecordBatchReader.from_batches(_GRAM, (b for r in same for b in _unpacked(r)))  # noqa: F841  read by name
                    sums = con.sql(
                        "SELECT lang, phrase, CAST(CASE WHEN phrase = '' THEN 0 ELSE length(phrase) - length(replace(phrase, ' ', '')) + 1 END AS INTEGER) AS words, n "
                        f"FROM (SELECT lang, phrase, CAST(sum(n) AS BIGINT) AS n FROM bucket GROUP BY lang, phrase) WHERE phrase = '' OR n >= {least:d}"
                    )
                    yield from (b.cast(_COUNT) for b in sums.to_arrow_reader(20_000))
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): phrases of up to `longest` words with `least` occurrences, and of no words the number of all words."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = textops.narrow(docs, F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), "text")
    pieces = rows.mapInArrow(_to_pieces, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    grams = pieces.mapInArrow(_to_grams(longest, buckets), "bucket int, langs array<string>, sizes array<int>, phrases binary, sums binary")
    return grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(least), "lang string, phrase string, words int, n long")


def _inside(words, longest: int):
    """Contiguous shorter phrases of an array of words, as (part, its number of words, the cut that it belongs to or 0, which side)."""
    joined = lambda i, k: F.concat_ws(" ", F.slice(words, i, k))
    asked = []
    for size in range(2, longest + 1):
        for k in range(1, size):
            for side, part in (("l", joined(1, k)), ("r", joined(k + 1, size - k))):
                asked.append((size, F.struct(part.alias("part"), F.lit(k).alias("cut"), F.lit(side).alias("side"))))
        for k in range(2, size):  # those inside that no cut makes
            for i in range(2, size - k + 1):
                asked.append((size, F.struct(joined(i, k).alias("part"), F.lit(0).alias("cut"), F.lit("i").alias("side"))))
    return F.filter(F.array(*[F.when(F.size(words) == n, s) for n, s in asked]), lambda s: s.isNotNull())


def collocations(counts: DataFrame, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language by the score of their weakest cut, from `phrase_counts` (read more than once)."""
    candidates = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"))
    requests = candidates.select("lang", "phrase", "a", F.explode(_inside(F.split("phrase", " "), longest)).alias("x")).select("lang", F.col("x.part").alias("part"), "phrase", "a", "x.cut", "x.side")
    # to the parts: each request meets the count of its part
    parts = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("words").alias("part_words"), F.col("n").alias("part_n"))
    answers = requests.join(parts, ["lang", "part"])
    # what a longer candidate says of the shorter ones inside it
    covered = answers.where((F.col("part_words") > 1) & (100 * F.col("a").cast("decimal(20,0)") >= SHARE * F.col("part_n").cast("decimal(20,0)"))).select("lang", F.col("part").alias("phrase")).distinct()
    # and back: both sides of each cut
    sides = answers.where("cut > 0").groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("side") == "l", F.col("part_n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("part_n"))).alias("r"))
    exact = F.expr("cast((cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * 1000000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    best = sides.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "cut")).alias("b")).select("lang", "phrase", "a", "b.*")
    kept = best.join(covered, ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for shares in LEVELS:
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("n").alias("n"))
    return kept.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first TOP phrases of each language; docs (lang, text)."""
    return collocations(textops.cut(phrase_counts(docs), "phrase-counts"))
