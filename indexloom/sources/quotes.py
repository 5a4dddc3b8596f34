"""Quotes: the explicit schema, readers, the normaliser and guards."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.functions import constants as C
from indexloom.sources import by_header

MONEY = T.DecimalType(12, 2)
QUOTE = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("basket_version", T.IntegerType()),
        T.StructField("collection_ts_utc", T.TimestampType()),
        T.StructField("collection_date", T.DateType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("destination", T.StringType()),
        T.StructField("lead_time_days", T.IntegerType()),
        T.StructField("dep_date", T.DateType()),
        T.StructField("carrier", T.StringType()),
        T.StructField("flight_no", T.StringType()),
        T.StructField("dep_ts", T.TimestampType()),
        T.StructField("arr_ts", T.TimestampType()),
        T.StructField("stops", T.IntegerType()),
        T.StructField("fare_class", T.StringType()),
        T.StructField("base_fare", MONEY),
        T.StructField("taxes", MONEY),
        T.StructField("fees", MONEY),
        T.StructField("total_fare", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("is_available", T.BooleanType()),
        T.StructField("is_cheapest_in_cell", T.BooleanType()),
        T.StructField("unavailable_reason", T.StringType()),
    ]
)
COLUMNS = QUOTE.fieldNames()
SIMULATED = "simulated quotes can't be published as an index"
TEXT = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
WEIGHTS = "origin string, destination string, pair string, pax double, weight double"


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All CSV files of a folder, or the named ones, as strings under the quote columns, bound by the names in each file's header.

    A missing collection date is taken from the file's name; what else a file lacks is null.
    """
    try:
        rows = by_header.read(spark, paths, TEXT, file=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no quotes in {paths}") from None
    stem = F.regexp_extract(by_header.FILE, r"(\d{4}-\d{2}-\d{2})", 1)
    return rows.withColumn("collection_date", F.coalesce("collection_date", F.nullif(stem, F.lit("")))).select(*COLUMNS)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Route weights from a CSV file with a header, in any order of its columns; pair and passengers may be missing."""
    return by_header.read(spark, path, WEIGHTS, required=("origin", "destination", "weight"), pattern=None)


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], **options: str) -> DataFrame:
    """A table over JDBC; projection and filters reach the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*columns)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "t", "yes"), F.lit(False))


def normalise(quotes: DataFrame) -> DataFrame:
    """Types and spellings settled: dates, truth values, upper-case codes, UNKNOWN carriers; rows without a lead time go."""
    has = quotes.columns
    df = (
        quotes.withColumn("collection_date", F.expr("try_cast(collection_date AS date)"))
        .withColumn("is_available", truthy(F.col("is_available")))
        .withColumn("total_fare", F.expr("try_cast(total_fare AS double)"))
        .withColumn("lead_time_days", F.expr("cast(try_cast(lead_time_days AS double) AS int)"))
        .withColumn("origin", F.trim(F.upper("origin")))
        .withColumn("destination", F.trim(F.upper("destination")))
        .withColumn("carrier", F.coalesce("carrier", F.lit("UNKNOWN")))
    )
    if "dep_ts" not in has:
        df = df.withColumn("dep_ts", F.lit(None).cast("timestamp"))
    df = df.withColumn("total_fare", F.when(F.isnan("total_fare"), None).otherwise(F.col("total_fare")))
    return df.where(F.col("lead_time_days").isNotNull())


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def simulated(columns: list[str]) -> Column:
    """Whether a row comes from a simulation."""
    flag = F.col("source").startswith("SIMULATED_")
    return flag | truthy(F.col("is_simulated")) if "is_simulated" in columns else flag


def reject_simulated(quotes: DataFrame) -> None:
    """Raises if any row comes from a simulation."""
    if quotes.where(simulated(quotes.columns)).limit(1).count():
        raise ValueError(SIMULATED)


def priced(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_available") & F.col("total_fare").isNotNull())


def quotes_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes made of the events table: users are spread over routes and lead times, event types are carriers."""
    from indexloom.functions.dimensions import routes

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp_ntz")
    day = F.to_date(ts)
    lead = F.element_at(F.array(*map(F.lit, C.LEAD_TIMES)), (F.expr("(user_id div 24) % 5") + 1).cast("int"))
    available = (F.col("event_type") != "error") & (F.col("value") > 0) & (day != F.lit("2024-01-15").cast("date"))
    reason = F.when(available, None).when((day == F.lit("2024-01-15").cast("date")) | (F.col("value") <= 0), "blocked").when(F.col("event_id") % 2 == 0, "sold_out").otherwise("timeout")
    r = F.broadcast(routes(spark).select("route_id", "origin", "destination"))  # 24 rows
    q = e.select(
        F.col("event_id").alias("quote_id"), ts.alias("collection_ts_utc"), day.alias("collection_date"), F.lit("s").alias("source"),
        (F.col("user_id") % 24).cast("int").alias("route_id"), lead.alias("lead_time_days"), F.col("event_type").alias("carrier"),
        F.col("value").alias("total_fare"), available.alias("is_available"), reason.alias("unavailable_reason"),
    )
    return q.join(r, "route_id").drop("route_id").select("quote_id", "collection_ts_utc", "collection_date", "source", "origin", "destination", "lead_time_days", "carrier", "total_fare", "is_available", "unavailable_reason")
