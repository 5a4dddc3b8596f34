"""Weighted aggregation, availability, scenario band and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.functions import constants as C


def check_orphans(levels: DataFrame, weights: DataFrame) -> None:
    """Raises if a stratum isn't in the basket, or the basket names a stratum twice."""
    if weights.groupBy("scenario", *C.STRATUM_KEY).count().where("count > 1").limit(1).count():
        raise ValueError("the basket has a stratum twice")
    orphan = levels.select(*C.STRATUM_KEY).distinct().join(weights, C.STRATUM_KEY, "left_anti").limit(5).collect()
    if orphan:
        raise ValueError(f"strata that the basket doesn't hold: {orphan}")


def cell_availability(quotes: DataFrame, cells_in_basket: int) -> DataFrame:
    """For each day the distinct cells with a price, with a failure and sold out; a cell may count in several.

    Quotes are first reduced to one row a cell and day, so the counts need no distinct over wide rows.
    """
    cell = quotes.groupBy("collection_date", *C.STRATUM_KEY).agg(
        F.bool_or(F.col("is_available") & F.col("total_fare").isNotNull()).alias("p"),
        F.bool_or(F.col("unavailable_reason").isin(*C.FAILURES)).alias("b"),
        F.bool_or(F.col("unavailable_reason").isin(*C.MARKET_SIGNALS)).alias("s"),
    )
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return cell.groupBy("collection_date").agg(n("p").alias("cells_priced"), F.lit(cells_in_basket).cast("long").alias("cells_in_basket"), (n("p") / cells_in_basket).alias("availability_rate"), n("b").alias("cells_blocked"), n("s").alias("cells_sold_out"))


def index_points(levels: DataFrame, weights: DataFrame, availability: DataFrame | None = None) -> DataFrame:
    """For each day and scenario the weighted mean of the levels there are, over the weight they carry.

    Without a census of cells the availability is the contributing weight.
    """
    merged = levels.join(F.broadcast(weights), C.STRATUM_KEY)  # routes x lead times x scenarios, fixed by the basket
    usable = F.col("stratum_index").isNotNull()
    got = merged.groupBy("collection_date", "scenario").agg(
        F.sum(F.when(usable, F.col("stratum_index") * F.col("weight"))).alias("_wi"),
        F.sum(F.when(usable, F.col("weight"))).alias("_w"),
        F.coalesce(F.sum(F.when(usable & (F.col("imputation_tier") == C.TIER_OBSERVED), F.col("weight"))), F.lit(0.0)).alias("_o"),
        F.count_if(usable).alias("strata_contributing"),
    )
    size = weights.groupBy("scenario").agg(F.count("*").alias("strata_in_basket"))
    got = got.where("_w > 0").join(F.broadcast(size), "scenario")
    rate = F.col("_w")
    if availability is not None:
        got = got.join(F.broadcast(availability.select("collection_date", "availability_rate")), "collection_date", "left")  # one row a day
        rate = F.col("availability_rate")
    return got.select("collection_date", "scenario", (F.col("_wi") / F.col("_w")).alias("index_value"), rate.alias("availability_rate"), (F.col("_o") / F.col("_w")).alias("observed_weight_share"), "strata_contributing", "strata_in_basket")


def published(points: DataFrame) -> DataFrame:
    """Points as they are published: values to four places."""
    out = points
    for c in ("index_value", "availability_rate", "observed_weight_share"):
        out = out.withColumn(c, F.round(c, 4))
    return out


def scenario_band(points: DataFrame) -> DataFrame:
    """For each day the scenarios side by side with their least, greatest and width."""
    names = sorted(C.SCENARIOS)
    wide = points.groupBy("collection_date").pivot("scenario", names).agg(F.avg("index_value"))
    return wide.withColumn("band_low", F.least(*names)).withColumn("band_high", F.greatest(*names)).withColumn("band_width", F.round(F.col("band_high") - F.col("band_low"), 4))


def resample(points: DataFrame, freq: str) -> DataFrame:
    """Weeks ending on Sunday ('W') or months ('MS') of each scenario: geometric mean index, mean rates, days. Empty periods inside the range stay."""
    if freq == "W":
        period, step = F.next_day(F.date_sub("collection_date", 1), "SU"), F.expr("interval 7 days")
    elif freq == "MS":
        period, step = F.trunc("collection_date", "MM"), F.expr("interval 1 month")
    else:
        raise ValueError(f"unknown frequency {freq!r}")
    got = points.withColumn("period", period).groupBy("scenario", "period").agg(
        F.exp(F.avg(F.log("index_value"))).alias("index_value"), F.avg("availability_rate").alias("availability_rate"),
        F.avg("observed_weight_share").alias("observed_weight_share"), F.count("index_value").alias("days_in_period"),
    )
    span = got.groupBy("scenario").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = span.select("scenario", F.explode(F.sequence("a", "b", step)).alias("period"))
    return grid.join(got, ["scenario", "period"], "left").withColumn("days_in_period", F.coalesce("days_in_period", F.lit(0).cast("long"))).withColumnRenamed("period", "collection_date")


def lead_curve(levels: DataFrame) -> DataFrame:
    """Mean level by day and lead time."""
    return levels.groupBy("collection_date", "lead_time_days").agg(F.avg("stratum_index").alias("stratum_index"))


def route_table(levels: DataFrame, dates: list[str]) -> DataFrame:
    """Mean level of each route (rows) on the given dates (columns)."""
    out = levels.withColumn("route", F.concat_ws("-", "origin", "destination"))
    return out.groupBy("route").agg(*[F.avg(F.when(F.col("collection_date") == F.lit(d).cast("date"), F.col("stratum_index"))).alias("d_" + d.replace("-", "_")) for d in dates])
