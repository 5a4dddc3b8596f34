"""An addition: daily quote files as a stream, with late files giving new vintages of the days they touch.

The stream is one of files, not of lines: every batch's files are read by their own headers, so that
columns may stand in any order, and land in one table of fixed columns. Streams that keep state, as
the counts in event time, read the landed table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.operators import collection
from indexloom.sources import store as stores
from indexloom.sources.quotes import TEXT, normalise, read_csv

FILES = "path string, modificationTime timestamp, length long, content binary"


def quote_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The names of files as they arrive, a bounded number in each batch; nothing of their content is read."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")


def landed(spark: SparkSession, store: str) -> DataFrame:
    """The quotes that `run` has landed, as a stream."""
    schema = normalise(spark.createDataFrame([], TEXT)).schema
    return spark.readStream.schema(schema).parquet(f"{store}/batch=*")


def windowed_counts(quotes: DataFrame, late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """Priced quotes of each source in event-time windows; what comes later than `late` is left out."""
    q = quotes.withColumn("ts", F.expr("try_cast(collection_ts_utc AS timestamp)")).withWatermark("ts", late)
    return q.groupBy(F.window("ts", size), "source").agg(F.count("*").alias("quotes"), F.count_if("is_available").alias("priced"))


def run(files: DataFrame, store: str, checkpoint: str, recompute: Callable[[DataFrame, list], None] | None = None):
    """Lands each batch of files in the store and hands the days it touched to `recompute`.

    A batch that is tried again after it has landed isn't written again, so readers of the store see
    its files once. Files without a header, as empty ones, land nothing.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, folder = df.sparkSession, f"{store}/batch={number}"
        if not stores.exists(spark, f"{folder}/_SUCCESS"):
            paths = [r.path for r in df.collect()]  # as many as a batch has files
            if not paths:
                return
            try:
                quotes = read_csv(spark, paths)
            except ValueError:  # none of them has a header
                return
            normalise(quotes).write.mode("overwrite").parquet(folder)
        if recompute is not None:
            days = [r.collection_date for r in spark.read.parquet(folder).select("collection_date").distinct().collect()]  # one row a day
            recompute(spark.read.parquet(store), sorted(d for d in days if d))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health(quotes: DataFrame) -> DataFrame:
    return collection.source_counters(quotes)
