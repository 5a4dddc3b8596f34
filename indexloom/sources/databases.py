"""Databases over JDBC: partitioned reads, and writes that may be repeated.

A write goes in two steps. Tasks append to staging tables, as Spark's own writer does: a task that is
tried again may leave its rows twice, and a lost driver may leave a table half filled. Then one transaction on one
connection moves what is staged into the targets and notes the write's name; it is all there or not at all. A write whose name
is noted already changes nothing, and a repeated one drops what an earlier attempt staged. Staged
rows are told apart by a number made of their content and place among equal ones, so the same row staged twice counts once.

Keys must not be null. Statements are standard SQL that PostgreSQL and Derby both read; staging tables
take their columns' types from the targets.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.operators import vintages

LOG = "applied_writes"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")

#: The columns of stored quotes that an index needs.
QUOTE_COLUMNS = ["quote_id", "collection_date", "collection_ts_utc", "source", "origin", "destination", "lead_time_days", "dep_date", "dep_ts", "carrier", "total_fare", "currency", "is_available", "unavailable_reason"]


@contextmanager
def connected(spark: SparkSession, url: str, **properties: str):
    """A connection of the driver's, with its transaction: committed at the end, rolled back on an error."""
    java = spark.sparkContext._jvm.java
    given = java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    if driver := properties.get("driver"):
        spark.sparkContext._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    con = java.sql.DriverManager.getConnection(url, given)
    try:
        con.setAutoCommit(False)
        yield con
        con.commit()
    except BaseException:
        con.rollback()
        raise
    finally:
        con.close()


def execute(con, sql: str, *values: str) -> int:
    """Runs one statement; returns the number of rows changed, or the first number of its result."""
    s = con.prepareStatement(sql)
    try:
        for k, v in enumerate(values, 1):
            s.setString(k, v)
        if not s.execute():
            return s.getUpdateCount()
        rows = s.getResultSet()
        return rows.getLong(1) if rows.next() else 0
    finally:
        s.close()


def _name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def has_table(con, table: str) -> bool:
    schema, _, name = _name(table).rpartition(".")
    found = con.getMetaData().getTables(None, None, None, None)
    while found.next():
        if found.getString("TABLE_NAME").lower() == name.lower() and (not schema or found.getString("TABLE_SCHEM").lower() == schema.lower()):
            return True
    return False


def read_table(spark: SparkSession, url: str, table: str, columns: Sequence[str], by: str | None = None, parts: int = 8, **properties: str) -> DataFrame:
    """Columns of a table; filters on them reach the database. With `by`, a number, date or time, `parts` tasks read a range of it each.

    The range's bounds are asked for once. They only divide the work: rows outside, and those without a
    value, come with the first or last part.
    """
    opened = lambda: spark.read.format("jdbc").options(url=url, fetchsize="10000", **properties)
    reader = opened()
    if by:
        bounds = opened().option("query", f"SELECT min({_name(by)}) AS lo, max({by}) AS hi FROM {_name(table)}").load().first()
        low, high = bounds[0], bounds[1]
        if low is not None and low != high:
            reader = reader.options(partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.option("dbtable", _name(table)).load().select(*columns)


def read_quotes(spark: SparkSession, url: str, table: str = "raw_quotes", parts: int = 8, **properties: str) -> DataFrame:
    """The stored quotes' columns that an index needs, in ranges of their numbers, which no busy day makes uneven."""
    return read_table(spark, url, table, QUOTE_COLUMNS, "quote_id", parts, **properties)


@dataclass(frozen=True)
class Into:
    """Rows for a table. Without a key they are appended; with one, rows whose key is there replace it (`replace`) or are left out."""

    rows: DataFrame
    table: str
    key: tuple[str, ...] = ()
    replace: bool = False
    latest: str | None = None  # of rows with one key, that with the greatest value of this column is written


def _staged(into: Into) -> DataFrame:
    """Rows with a number of their own, the same whenever and wherever they are made."""
    if into.key:
        rows = vintages.keep_latest(into.rows, list(into.key), into.latest) if into.latest else into.rows.dropDuplicates(list(into.key))
        return rows.withColumn("staged_no", F.sha2(F.to_json(F.struct(*into.key), {"ignoreNullFields": "false"}), 256))
    counted = into.rows.groupBy(*into.rows.columns).agg(F.count("*").alias("staged_no"))  # equal rows are told apart by their place only
    text = F.sha2(F.to_json(F.struct(*into.rows.columns), {"ignoreNullFields": "false"}), 256)
    return counted.withColumn("staged_no", F.explode(F.sequence(F.lit(1), F.col("staged_no")))).withColumn("staged_no", F.concat_ws("-", text, F.col("staged_no").cast("string")))


def write(spark: SparkSession, url: str, name: str, parts: Sequence[Into], **properties: str) -> bool:
    """Writes all parts or none, once for each name; says whether it did. Nothing is read back to the driver but counts."""
    stage = [f"stage_{name}_{k}" for k in range(len(parts))]
    _name(name)
    with connected(spark, url, **properties) as con:
        if not has_table(con, LOG):
            execute(con, f"CREATE TABLE {LOG} (name VARCHAR(200) NOT NULL PRIMARY KEY)")
        if execute(con, f"SELECT count(*) FROM {LOG} WHERE name = ?", name):
            return False
        for table, into in zip(stage, parts, strict=True):
            if has_table(con, table):
                execute(con, f"DROP TABLE {table}")
            columns = ", ".join(map(_name, into.rows.columns))
            execute(con, f"CREATE TABLE {table} AS SELECT {columns}, CAST('' AS VARCHAR(90)) AS staged_no FROM {_name(into.table)} WITH NO DATA")
    for table, into in zip(stage, parts, strict=True):
        _staged(into).write.format("jdbc").options(url=url, dbtable=table, batchsize="5000", **properties).mode("append").save()
    with connected(spark, url, **properties) as con:
        execute(con, f"INSERT INTO {LOG} (name) VALUES (?)", name)  # of two writers with one name the second fails here
        for table, into in zip(stage, parts, strict=True):
            columns = ", ".join(into.rows.columns)
            same = " AND ".join(f"t.{c} = s.{c}" for c in map(_name, into.key))
            if into.replace:
                execute(con, f"DELETE FROM {into.table} t WHERE EXISTS (SELECT 1 FROM {table} s WHERE {same})")
            absent = f" WHERE NOT EXISTS (SELECT 1 FROM {into.table} t WHERE {same})" if into.key else ""
            execute(con, f"INSERT INTO {into.table} ({columns}) SELECT {', '.join('s.' + c for c in into.rows.columns)} FROM (SELECT DISTINCT {columns}, staged_no FROM {table}) s{absent}")
        for table in stage:
            execute(con, f"DROP TABLE {table}")
    return True


def write_collection(spark: SparkSession, url: str, name: str, run: DataFrame, quotes: DataFrame, health: DataFrame, robots: DataFrame, **properties: str) -> bool:
    """One collection run: its row replaces an earlier one of its run_id, quotes and robots decisions are appended, a source's health is kept if it is there.

    False, with the reason logged, if any of it can't be written; then none of it is.
    """
    parts = [Into(run, "collection_runs", ("run_id",), replace=True), Into(quotes, "raw_quotes"), Into(health, "source_health", ("run_id", "source")), Into(robots, "robots_log")]
    try:
        return write(spark, url, name, parts, **properties)
    except Exception:
        logging.getLogger(__name__).exception("collection %s wasn't written", name)
        return False


def write_vintage(spark: SparkSession, url: str, name: str, values: DataFrame, **properties: str) -> bool:
    """Index values of one computation; those whose key is stored already stay as they are."""
    return write(spark, url, name, [Into(values, "index_values", (*vintages.KEY, "computed_at_utc"))], **properties)
