"""Token-id output as bit- or byte-plane files.

Documents are put in ascending doc_id order (equal ids by a hash of their text; nulls first) by a
range partitioning, so that no key has to sort in one task. Each task encodes its range and writes
segments. A segment is one file image: fixed-size blocks of ids, each block transposed into byte or
bit planes, each plane compressed with zstandard, and at the end a chunk index that gives every
block's first id and its planes' places. Spark writes the images as the rows of a table, with its
own commit protocol, so lost executors leave no half-written segment; any store that Spark knows
will do. What passes through the driver is one number for each task.

Null and empty texts are one end id. Repeated rows are written as often as they occur. A text of any
length is one run of ids; blocks don't end with documents. An empty table gives no segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.llm import textops
from indexloom.llm.wordcode import coder, public_path

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20  # a segment ends with the document that reaches this number of ids
END_ID = 2
CACHE_WORDS = 500_000  # of each worker
MAGIC = b"PLN1"
_HEAD = struct.Struct("<4sBIQ")  # magic, planes of a block, ids of a block, ids
_FOOT = struct.Struct("<QI4s")  # place of the index, blocks, magic

SEGMENT_SCHEMA = "shard int, seq long, before long, n_docs long, n_ids long, docs binary, file binary"
_SEGMENT = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.binary()), ("file", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    raw = np.empty((n, 4), dtype=np.uint8)
    if len(planes) == 4:
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, dtype=np.uint8)
    else:
        spread = np.empty((n, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            spread[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
        raw[:] = np.packbits(spread, axis=1, bitorder="little")
    return raw.reshape(-1).view("<u4")


def write_file(ids: np.ndarray, block: int = BLOCK_IDS, bits: bool = False, level: int = 3) -> bytes:
    """The image of a file with these ids."""
    press = zstandard.ZstdCompressor(level=level)
    n_planes = 32 if bits else 4
    out = [_HEAD.pack(MAGIC, n_planes, block, len(ids))]
    at, index = _HEAD.size, []
    for low in range(0, len(ids), block):
        part = ids[low : low + block]
        packed = [press.compress(p) for p in to_planes(part, bits)]
        index.append(struct.pack(f"<QIQ{n_planes}I", low, len(part), at, *map(len, packed)))
        out += packed
        at += sum(map(len, packed))
    out += index
    out.append(_FOOT.pack(at, len(index), MAGIC))
    return b"".join(out)


def read_file(image: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """ids[start:stop] of an image; only the blocks that hold them are decompressed."""
    magic, n_planes, _, total = _HEAD.unpack_from(image)
    at, blocks, foot = _FOOT.unpack_from(image, len(image) - _FOOT.size)
    if magic != MAGIC or foot != MAGIC:
        raise ValueError("not a plane file, or a truncated one")
    stop = total if stop is None else min(stop, total)
    entry = struct.Struct(f"<QIQ{n_planes}I")
    press, parts = zstandard.ZstdDecompressor(), []
    for k in range(blocks):
        first, n, place, *sizes = entry.unpack_from(image, at + k * entry.size)
        if first >= stop or first + n <= start:
            continue
        planes = []
        for s in sizes:
            planes.append(press.decompress(image[place : place + s]))
            place += s
        parts.append(from_planes(planes, n)[max(0, start - first) : stop - first])
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


def _pack_docs(keys: list, lengths: np.ndarray) -> bytes:
    known = np.fromiter((k is not None for k in keys), dtype=np.uint8, count=len(keys))
    values = np.fromiter((k or 0 for k in keys), dtype="<i8", count=len(keys))
    return zstandard.ZstdCompressor(level=3).compress(known.tobytes() + values.tobytes() + lengths.astype("<i8").tobytes())


def _unpack_docs(raw: bytes, n: int) -> tuple[list, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    known = np.frombuffer(data, dtype=np.uint8, count=n)
    values = np.frombuffer(data, dtype="<i8", count=n, offset=n)
    return [v if k else None for k, v in zip(known, values.tolist(), strict=True)], np.frombuffer(data, dtype="<i8", count=n, offset=9 * n)


def _writer(path: str, end_id: int, bits: bool, block: int, segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard = coder(path, CACHE_WORDS), TaskContext.get().partitionId()
        keys, lengths, parts, held, before, seq = [], [], [], 0, 0, 0

        def close():
            ids = np.concatenate(parts)
            return textops.batch_of(_SEGMENT, [shard], [seq], [before], [len(keys)], [len(ids)], [_pack_docs(keys, np.concatenate(lengths))], [write_file(ids, block, bits)])

        for batch in batches:
            for piece in textops.slices(batch, limit=4_000_000):
                ids, at = words.encode(textops.text_column(piece))
                keys += piece.column(0).cast(pa.int64()).to_pylist()
                lengths.append(np.diff(at) + 1)
                parts.append(np.insert(ids, at[1:], end_id).astype("<u4"))
                held += len(parts[-1])
                if held >= segment:
                    yield close()
                    before, seq = before + held, seq + 1
                    keys, lengths, parts, held = [], [], [], 0
        if keys:
            yield close()

    return run


def write_ids(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID, bits: bool = False, block: int = BLOCK_IDS, segment: int = SEGMENT_IDS) -> None:
    """Encodes docs (doc_id, text), each followed by end_id, and writes segments to the folder `target`."""
    ordered = textops.narrow(docs, "doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(_writer(path or public_path(), end_id, bits, block, segment), SEGMENT_SCHEMA).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(target)


def segments(spark: SparkSession, source: str) -> DataFrame:
    """The segments of a folder with the number of ids before each (`first`)."""
    table = spark.read.schema(SEGMENT_SCHEMA).parquet(source)
    totals = {r.shard: r.n for r in table.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # one row for each task of the write
    offsets, at = [], 0
    for shard in sorted(totals):
        offsets.append((shard, at))
        at += totals[shard]
    frame = spark.createDataFrame(offsets, "shard int, base long")
    return table.join(F.broadcast(frame), "shard").withColumn("first", F.col("base") + F.col("before"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, docs, image in zip(*(batch.column(k) for k in range(4)), strict=True):
            keys, lengths = _unpack_docs(docs.as_py(), n.as_py())
            raw = read_file(image.as_py()).astype("<u4")
            at = np.concatenate([[0], np.cumsum(lengths)])
            yield textops.batch_of(_READ, keys, at[:-1] + first.as_py(), lengths, [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)])


def read_digests(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    return segments(spark, source).select("first", "n_docs", "docs", "file").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _id_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
    for batch in batches:
        for first, n, docs, image in zip(*(batch.column(k) for k in range(4)), strict=True):
            keys, lengths = _unpack_docs(docs.as_py(), n.as_py())
            at = np.concatenate([[0], np.cumsum(lengths)])
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(read_file(image.as_py()).astype(np.int64)))
            yield textops.batch_of(schema, keys, at[:-1] + first.as_py(), ids)


def read_ids(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start and ids of every document, from the files."""
    return segments(spark, source).select("first", "n_docs", "docs", "file").mapInArrow(_id_reader, "doc_id long, start long, ids array<long>")
