"""From offers to quotes: rows for what was found and for what wasn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.operators.collection import cheapest_in_cell

CELL = ["collection_date", "source", "origin", "destination", "lead_time_days"]


def to_quotes(offers: DataFrame, order: str) -> DataFrame:
    """Offers with a positive fare as available quotes, the cheapest of each cell flagged (the first by `order` among equals)."""
    q = cheapest_in_cell(offers.withColumn("total_fare", F.col("total_fare").cast("decimal(12,2)")), CELL, order)
    return q.withColumn("is_available", F.lit(True)).withColumn("unavailable_reason", F.lit(None).cast("string")).withColumn("currency", F.lit("INR")).withColumn("dep_date", F.date_add("collection_date", F.col("lead_time_days")))


def unavailable(cells: DataFrame, reason: str) -> DataFrame:
    """One row without a price for each cell, with the reason."""
    if reason not in (*C.MARKET_SIGNALS, *C.FAILURES):
        raise ValueError(f"unknown reason {reason!r}")
    return cells.select(*CELL, F.lit(None).cast("decimal(12,2)").alias("total_fare"), F.lit(False).alias("is_available"), F.lit(reason).alias("unavailable_reason"), F.lit(False).alias("is_cheapest_in_cell"))


def is_market_signal(reason):
    """Does the reason say something of the market, rather than of the collection?"""
    return reason.isin(*C.MARKET_SIGNALS)


def one_row_a_cell(cells: DataFrame, found: DataFrame, reason: str = "parse_error") -> DataFrame:
    """Quotes of the cells that gave offers, and a row with the reason for each that didn't."""
    missing = cells.join(found.select(*CELL).distinct(), CELL, "left_anti")
    return found.unionByName(unavailable(missing, reason), allowMissingColumns=True)
