"""Append-only writers. None of them overwrites what is there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.operators import aggregate, imputation, vintages
from indexloom.plans.index_build import IndexBuild
from indexloom.sources import by_header
from indexloom.sources.quotes import COLUMNS


def as_row(quotes: DataFrame) -> DataFrame:
    """Quotes as texts in their fixed columns, extra ones left out: decimals as they are, times in ISO 8601."""
    kinds = dict(quotes.dtypes)

    def text(c: str):
        if c not in kinds:
            return F.lit(None).cast("string")
        iso = "yyyy-MM-dd'T'HH:mm:ssXXX" if kinds[c] == "timestamp" else "yyyy-MM-dd'T'HH:mm:ss"
        return F.date_format(c, iso) if kinds[c].startswith("timestamp") else F.col(c).cast("string")

    return quotes.select(*[text(c).alias(c) for c in COLUMNS])


def append_quotes(quotes: DataFrame, folder: str, files_a_day: int = 8) -> None:
    """One folder for each collection day, whose rows at most files_a_day tasks write."""
    rows = as_row(quotes).withColumn("day", F.substring("collection_date", 1, 10))
    rows.repartition(F.col("day"), F.pmod(F.xxhash64(*COLUMNS), F.lit(files_a_day))).write.mode("append").partitionBy("day").option("header", True).csv(folder)


def stamped(df: DataFrame, version: str) -> DataFrame:
    """Adds the time of computation and the code's version."""
    return df.withColumn("computed_at_utc", F.current_timestamp()).withColumn("code_version", F.lit(version))


def register_views(frames: dict[str, DataFrame]) -> None:
    """Staging and clean layers as views, for SQL on top of them."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def save_tables(frames: dict[str, DataFrame]) -> None:
    """Marts as tables of the catalogue; an existing table is an error."""
    for name, df in frames.items():
        df.write.mode("errorifexists").saveAsTable(name)


def write_outputs(frames: dict[str, DataFrame], folder: str, version: str, simulated: bool = False) -> None:
    """Each frame as CSV in a folder of its own, in order of date; what comes from a simulation says so in a column."""
    for name, df in frames.items():
        df = df.withColumn("is_simulated", F.lit(True)) if simulated else df
        keys = [c for c in ("collection_date", "scenario") if c in df.columns]
        out = stamped(df, version)
        (out.orderBy(*keys) if keys else out).write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}")


def append_vintage(values: DataFrame, folder: str) -> DataFrame:
    """Appends values (with computed_at_utc) that the table doesn't hold yet, and returns the newest vintage of each point."""
    spark = values.sparkSession
    try:
        old = spark.read.schema(values.schema).parquet(folder)
        new = values.join(old.select(*vintages.KEY, "computed_at_utc"), [*vintages.KEY, "computed_at_utc"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        new = values
    new.select(*values.columns).write.mode("append").parquet(folder)
    return vintages.latest(spark.read.schema(values.schema).parquet(folder))


def encoded(columns: list[str]):
    """The columns' values as one text that no other values give: each with its length before it, nulls marked."""
    value = lambda c: F.col(c).cast("string")
    return F.concat(*[F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c))) for c in columns])


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of the rows' content, whatever their order: their number and two sums of 60 bits of each row's own digest."""
    row = F.sha2(encoded(columns), 256)
    part = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(20,0)"))
    sums = df.select(row.alias("_h")).agg(F.count("*").alias("n"), F.coalesce(part(1), F.lit(0)).alias("a"), F.coalesce(part(16), F.lit(0)).alias("b"))
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("sha256"))


def index_meta(build: IndexBuild, headline: str = C.HEADLINE) -> DataFrame:
    """One row on a build: its days, the newest point of the headline and of the band, drift, and imputation by day."""
    newest = lambda df, name: df.agg(F.max_by(F.struct(*df.columns), "collection_date").alias(name))
    days = build.days.agg(F.count("*").alias("collection_days"), F.min("collection_date").alias("first_day"), F.max("collection_date").alias("last_day"))
    out = days.withColumn("headline_scenario", F.lit(headline)).crossJoin(newest(aggregate.published(build.headline(headline)), "latest")).crossJoin(newest(build.band(), "band_latest"))  # single rows
    drift, tiers = build.drift(), imputation.summary(build.imputed)
    return out.crossJoin(drift.agg(F.first(F.struct(*drift.columns)).alias("chain_drift"))).crossJoin(tiers.agg(F.array_sort(F.collect_list(F.struct(*tiers.columns))).alias("imputation_by_day")))  # a row a day


def write_meta(build: IndexBuild, folder: str, version: str) -> None:
    """index_meta with the time and the code's version, as one JSON document."""
    stamped(index_meta(build), version).coalesce(1).write.mode("errorifexists").json(folder)


@dataclass(frozen=True)
class Stored:
    """What a stored output gave: its rows, or why there are none."""

    rows: DataFrame | None
    reason: str | None = None


def read_stored(spark: SparkSession, path: str, schema: str | None = None) -> Stored:
    """A stored output (CSV with header): its columns as texts, or those of the schema by their names, or a typed answer that it is missing."""
    try:
        return Stored(by_header.read(spark, path, schema, pattern=None) if schema else spark.read.option("header", True).csv(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Stored(None, f"nothing stored at {path}")
