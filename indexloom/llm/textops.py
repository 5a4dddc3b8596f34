"""Vectorised text helpers that run inside Spark tasks.

All of them work on one Arrow slice of documents at a time (a few MB of text), so the memory of a
task depends on the slice and on the longest single document, never on the table.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 1_500_000
BATCH_ROWS = 2000  # rows that Spark hands to a Python worker at once, at most

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the polynomial hashes' base, modulo 2**64."""
    t = np.full(max(n, 1), _A, dtype=np.uint64)
    t[0] = 1
    return np.cumprod(t, dtype=np.uint64)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large_string without nulls (null becomes the empty text)."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type):
        col = pa.nulls(len(col), pa.large_string())
    return pc.fill_null(col.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about `limit` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(s)
    yield batch.slice(start)


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls; offsets[i]:offsets[i+1] is row i."""
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of a word: digits, lower-case letters and all of UTF-8 beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = True
WORD_BYTE[0x61:0x7B] = True
WORD_BYTE[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def hashed(values: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values. xxHash mixes each byte with its place and length, so that no pattern of letters cancels out."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.to_pylist()), dtype=np.uint64, count=len(values))


class Words:
    """The words of a slice: their byte spans, each document's range of words, and exact codes.

    Words with the same bytes have the same code, others never: `id` points into `distinct`. `hash`
    is for what must compare across slices; who compares by it says how it is verified or how rarely it errs.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = WORD_BYTE, lower: bool = True):
        buf = lower_ascii(buf) if lower else buf
        n = len(buf)
        self.size = n
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = word_byte[buf]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        # only the bytes of words, one word after another
        places = np.concatenate([[0], np.cumsum(self.end - self.start)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(buf[inside[1:-1]]))])
        coded = words.dictionary_encode()
        self.id = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary

    @cached_property
    def hash(self) -> np.ndarray:
        return hashed(self.distinct)[self.id] if len(self.id) else np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes (len(words) - n + 1 of them)."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(k, dtype=np.uint64)
    for i in range(n):
        out = out * _B + words[i : i + k]
    return mix(out)


def narrow(df: DataFrame, *columns) -> DataFrame:
    """df's columns (all, if none is named) for a pass through Python workers, in batches small enough for long texts."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns it reread: lineage ends there."""
    return put(df, name)[0]


def put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `cut`, with the path, for `drop` once nothing reads it any more."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables written by `put`, in whatever store they are."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(rows: DataFrame, by: str, key: list[str], n: int) -> DataFrame:
    """About n rows of each value of `by` (all, where there are fewer; twice n at most), chosen by a hash of `key`.

    The classes' sizes give each a share of the hash range, so the rows aren't sorted or shuffled
    and the choice doesn't depend on how they are partitioned; what is chosen is cut at twice n, in
    case a third of all rows should have one key. `by` has few values, as class labels have. A column
    `rank` orders the sample.
    """
    sizes = {r[0]: r.n for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    rank = F.pmod(F.xxhash64(*key), F.lit(1_000_000_007))
    limit = F.lit(-1)
    for value, size in sizes.items():
        if value is not None:
            limit = F.when(F.col(by) == F.lit(value), F.lit(int(min(1.0, n / size) * 1_000_000_007))).otherwise(limit)
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= limit)
    place = F.row_number().over(Window.partitionBy(by).orderBy("rank", *key))
    return chosen.withColumn("_place", place).where(F.col("_place") <= 2 * n).drop("_place")


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
