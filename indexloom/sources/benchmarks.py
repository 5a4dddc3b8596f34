"""Outside series: price-index exports with unknown headers, traffic tables, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.sources import by_header

TRAFFIC = "City1 string, City2 string, PaxToCity2 double, PaxFromCity2 double, Year int, Month int"


def _find(columns: list[str], *parts: str) -> str | None:
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def normalise_export(df: DataFrame) -> DataFrame:
    """(month, cpi_index) of an export: columns are found by parts of their names; unreadable rows go; nothing left is an error."""
    value = _find(df.columns, "index", "value", "cpi")
    year, month = _find(df.columns, "year"), _find(df.columns, "month")
    whole = _find(df.columns, "date", "period")
    if value is None or not ((year and month) or whole):
        raise ValueError(f"no value or date column among {df.columns}")
    if year and month:
        m = F.col(month).cast("string")
        number = F.coalesce(m.try_cast("int"), F.month(F.try_to_timestamp(F.concat(F.initcap(F.substring(F.trim(m), 1, 3)), F.lit(" 2000")), F.lit("MMM yyyy"))))
        day = F.try_to_timestamp(F.format_string("%s-%02d-01", F.col(year).cast("string"), number), F.lit("yyyy-MM-dd")).cast("date")
    else:
        s = F.col(whole).cast("string")
        day = F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in ("yyyy-MM-dd", "yyyy-MM", "dd/MM/yyyy", "MMM yyyy", "MMM-yyyy")]).cast("date")
    out = df.select(F.trunc(day, "MM").alias("month"), F.col(value).cast("string").try_cast("double").alias("cpi_index")).dropna()
    if not out.limit(1).count():
        raise ValueError("no readable row in the export")
    return out


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    """Traffic between cities by month, from CSV files in any order of their columns, with ym = Year * 100 + Month."""
    return by_header.read(spark, path, TRAFFIC, required=tuple(T.StructType.fromDDL(TRAFFIC).fieldNames()), pattern=None).withColumn("ym", F.col("Year") * 100 + F.col("Month"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
