"""Item prices and matched Jevons relatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.sources.quotes import priced, require_columns


def item_prices(quotes: DataFrame) -> DataFrame:
    """The cheapest price of each item and day. A price of zero or less fails the query; items without a carrier go."""
    require_columns(quotes, [*C.ITEM_KEY, "collection_date", "total_fare", "is_available"])
    fare = F.col("total_fare").cast("double")
    checked = F.when(fare > 0, fare).otherwise(F.raise_error(F.lit("an available quote has a price of zero or less")).cast("double"))
    ok = priced(quotes).withColumn("total_fare", checked)
    for k in C.ITEM_KEY:
        ok = ok.where(F.col(k).isNotNull())
    return ok.groupBy(*C.ITEM_KEY, "collection_date").agg(F.min("total_fare").alias("total_fare"))


def calendar(quotes: DataFrame) -> DataFrame:
    """The collection dates present, numbered from 1: the day before is the one numbered one less, whatever the gap."""
    days = quotes.select("collection_date").where("collection_date is not null").distinct()
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("collection_date")))  # one row a day: a small table


def strata(quotes: DataFrame) -> DataFrame:
    return quotes.select(*C.STRATUM_KEY).distinct()


def jevons_relatives(items: DataFrame, days: DataFrame, universe: DataFrame) -> DataFrame:
    """For each stratum and day (but the first) the geometric mean of its matched items' price relatives, null if none matched.

    One window over the item key finds each item's previous price; a price counts as matched if it
    stands exactly one collection day back. The table of strata and days is the scaffold.
    """
    numbered = items.join(F.broadcast(days), "collection_date")  # one row a day
    w = Window.partitionBy(*C.ITEM_KEY).orderBy("day_no")
    before = F.lag("day_no").over(w) == F.col("day_no") - 1
    pairs = numbered.withColumn("log_relative", F.when(before, F.log(F.col("total_fare") / F.lag("total_fare").over(w))))
    per_day = pairs.groupBy(*C.STRATUM_KEY, "day_no").agg(F.exp(F.avg("log_relative")).alias("relative"), F.count("log_relative").alias("matched_items"), F.count("*").alias("items"))
    grid = universe.crossJoin(F.broadcast(days)).where("day_no > 1")
    earlier = per_day.select(*C.STRATUM_KEY, (F.col("day_no") + 1).alias("day_no"), F.col("items").alias("items_prev_period"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        grid.join(per_day.withColumnRenamed("items", "items_this_period"), [*C.STRATUM_KEY, "day_no"], "left")
        .join(earlier, [*C.STRATUM_KEY, "day_no"], "left")
        .select(*C.STRATUM_KEY, "collection_date", "day_no", "relative", zero("matched_items"), zero("items_this_period"), zero("items_prev_period"))
    )


def strata_seen(items: DataFrame, days: DataFrame) -> DataFrame:
    """For each day but the first the strata priced on it or on the collection day before."""
    seen = items.select("collection_date", *C.STRATUM_KEY).distinct().join(F.broadcast(days), "collection_date").select(*C.STRATUM_KEY, "day_no")  # one row a day
    both = seen.unionByName(seen.withColumn("day_no", F.col("day_no") + 1)).distinct()
    return both.join(F.broadcast(days), "day_no").where("day_no > 1").select("collection_date", *C.STRATUM_KEY)
