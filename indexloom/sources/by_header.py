"""CSV files bound by the names in their headers, whatever the order of their columns.

Every file's header is read from its first block alone, in tasks over the list of files: what is read
follows their number and not their size. Tasks open the stores that Arrow knows; what lies in another
one, which only Spark's own file systems reach, is opened by the driver, some files at a time. Files
with the same header are then read together, as texts; columns are found by name and cast. A name that
a file lacks is null there, one that no file has is an error if it is required, further columns are
left out, and of a repeated name the first column counts. Values that can't be read as their type are
null. Files without a line have no header and are left out.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16  # bytes that are read of a file at once, until its first line ends
FILE = "_file"
_LINES = pa.schema([("file", pa.string()), ("line", pa.string())])


def _first_line(uri: str) -> str | None:
    """The first line of a file; None if Arrow doesn't know its store."""
    try:
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    line = b""
    with store.open_input_stream(path) as stream:
        while b"\n" not in line and (block := stream.read(BLOCK)):
            line += block
    return line.split(b"\n", 1)[0].decode("utf-8", "replace")


def _read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(map(_first_line, files), pa.string())], schema=_LINES)


def _through_spark(spark: SparkSession, uri: str) -> str:
    """The first line of a file in a store that only Spark's file systems reach."""
    java = spark.sparkContext._jvm
    path = java.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return java.java.io.BufferedReader(java.java.io.InputStreamReader(stream, "UTF-8"), BLOCK).readLine() or ""
    finally:
        stream.close()


def first_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = "*.csv") -> list[tuple[str, str]]:
    """(file, its first line). One row a file comes to the driver, which lists the files anyway."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths).select("path")  # the content isn't read
    rows = files.mapInArrow(_read_heads, "file string, line string").collect()
    far = [r.file for r in rows if r.line is None]
    with ThreadPoolExecutor(16) as pool:
        return sorted([(r.file, r.line) for r in rows if r.line is not None] + list(zip(far, pool.map(lambda f: _through_spark(spark, f), far), strict=True)))


def names_of(line: str) -> list[str]:
    return next(csv.reader([line.removeprefix("﻿").rstrip("\r")]), [])


def headers(spark: SparkSession, paths: str | list[str], pattern: str | None = "*.csv") -> dict[tuple[str, ...], list[str]]:
    """Header -> the files that have it, in order."""
    out: dict[tuple[str, ...], list[str]] = {}
    for file, line in first_lines(spark, paths, pattern):
        if names := names_of(line):
            out.setdefault(tuple(names), []).append(file)
    return dict(sorted(out.items()))


def typed(text: Column, kind: T.DataType) -> Column:
    """A text as a value of the type, or null; whole numbers may be written with a fraction of zero."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
        number = text.try_cast("double")
        return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))
    return F.trim(text).try_cast(kind)


def read(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, required: tuple[str, ...] = (), pattern: str | None = "*.csv", file: bool = False) -> DataFrame:
    """The rows of all files under the schema's columns; with `file`, the file's name in a column FILE too. No file at all is an error."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    groups = headers(spark, paths, pattern)
    if not groups:
        raise ValueError(f"no file with a header in {paths}")
    missing = sorted(set(required) - {name for names in groups for name in names})
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return reduce(DataFrame.unionByName, [_group(spark, names, files, schema, file) for names, files in groups.items()])


def _group(spark: SparkSession, names: tuple[str, ...], files: list[str], schema: T.StructType, file: bool) -> DataFrame:
    places = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.schema(places).option("header", True).option("mode", "PERMISSIVE").csv(files)
    columns = [(typed(F.col(f"_{names.index(f.name)}"), f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return raw.select(*columns, *[F.col("_metadata.file_name").alias(FILE)] * file)
