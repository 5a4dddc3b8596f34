"""Series stored for serving: folders by series and month, files in order of date, read in ranges that open no other files.

A published series is written once and read often, mostly a few days of one scenario or stratum. Its
columns become folders, and the month of its date a further one; within a folder the rows lie in order
of date. Spark then leaves out folders by their names, and row groups by their least and greatest date.
"""

from __future__ import annotations

import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "series_month"


def _month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def store_series(df: DataFrame, folder: str, series: list[str], date: str = "collection_date", rows_a_file: int = 5_000_000, codec: str = "zstd") -> None:
    """Writes rows into folders by `series` and month, in order of `date`; what is there already is an error.

    Tasks take ranges of series, date and a hash of the whole row, so that a series that holds most of
    the rows is divided among many tasks by date, and a single date of it by the hash. A null series or
    date has a folder of its own. A file holds `rows_a_file` rows at most; an empty table keeps its columns.
    """
    if MONTH in df.columns:
        raise ValueError(f"{MONTH} is the name of the folder of months")
    rows = df.withColumn(MONTH, _month(F.col(date)))
    order = [*series, MONTH, date]
    dealt = rows.repartitionByRange(*order, F.xxhash64(*[c for c in df.columns if not dict(df.dtypes)[c].startswith("map")]))
    writer = dealt.sortWithinPartitions(*order).write.mode("errorifexists").option("maxRecordsPerFile", rows_a_file).option("compression", codec)
    writer.partitionBy(*series, MONTH).parquet(folder)


def read_series(spark: SparkSession, folder: str, schema: str, first: datetime.date | None = None, last: datetime.date | None = None, date: str = "collection_date", **series: object) -> DataFrame:
    """The stored rows of the given series from the first to the last date, with the columns of `schema`.

    A range of dates is said twice: of months, which leaves out folders, and of dates, which leaves out
    parts of files. A series given as None is the one whose name is null.
    """
    wanted = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in series.items()]
    if first is not None:
        wanted += [F.col(MONTH) >= f"{first:%Y-%m}", F.col(date) >= F.lit(first)]
    if last is not None:
        wanted += [F.col(MONTH) <= f"{last:%Y-%m}", F.col(date) <= F.lit(last)]
    rows = spark.read.schema(f"{schema}, {MONTH} string").parquet(folder)
    return (rows.where(reduce(and_, wanted)) if wanted else rows).drop(MONTH)
