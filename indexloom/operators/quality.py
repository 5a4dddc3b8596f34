"""Staging, robust outlier flags and the daily marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions import constants as C

DEDUPE_KEY = ["collection_date", "source", "origin", "destination", "lead_time_days"]


def ist(c: str):
    """A UTC wall-clock time as Indian wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col(c).cast("timestamp_ntz"))


def stage(raw: DataFrame) -> DataFrame:
    """The first observation of each quote key, with Indian times, route, observed lead days, weekday (Sunday 0) and hour."""
    w = Window.partitionBy(*DEDUPE_KEY, F.coalesce("carrier", F.lit("")), F.coalesce("flight_no", F.lit(""))).orderBy(F.col("collection_ts_utc").asc(), F.col("quote_id").asc())
    first = raw.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return (
        first.withColumn("collection_ts_ist", ist("collection_ts_utc"))
        .withColumn("route", F.concat_ws("-", "origin", "destination"))
        .withColumn("observed_lead_days", F.datediff("dep_date", "collection_date"))
        .withColumn("dep_ts_ist", ist("dep_ts"))
        .withColumn("dep_dow", F.dayofweek("dep_ts_ist") - 1)
        .withColumn("dep_hour", F.hour("dep_ts_ist"))
    )


def route_stats(staged: DataFrame) -> DataFrame:
    """Exact median and median absolute deviation of the available prices of each route and lead time.

    The exact percentile keeps counts of distinct prices, whose number the currency's unit bounds.
    """
    keys = ["route", "lead_time_days"]
    ok = staged.where(F.col("is_available") & F.col("total_fare").isNotNull()).select(*keys, "total_fare")
    med = ok.groupBy(*keys).agg(F.expr("percentile(total_fare, 0.5)").alias("median_fare"), F.count("*").alias("n_observations"))
    dev = ok.join(med, keys).groupBy(*keys).agg(F.expr("percentile(abs(total_fare - median_fare), 0.5)").alias("mad_fare"))
    return med.join(dev, keys)


def clean(staged: DataFrame) -> DataFrame:
    """Every staged row with its route's statistics, robust z and one quality flag; nothing is dropped."""
    s = route_stats(staged)
    df = staged.join(s, ["route", "lead_time_days"], "left")
    low, high = C.CONTRACT_FARES
    z = 0.6745 * (F.col("total_fare") - F.col("median_fare")) / F.nullif("mad_fare", F.lit(0.0))
    robust = F.when(~F.col("is_available"), None).when(F.coalesce("mad_fare", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.round(z, 3))
    flag = (
        F.when(~F.col("is_available"), "unavailable").when(F.col("total_fare").isNull(), "no_price").when(F.col("total_fare") < low, "implausibly_low")
        .when(F.col("total_fare") > high, "implausibly_high").when(F.col("observed_lead_days") != F.col("lead_time_days"), "lead_time_mismatch").when(F.abs(z) > 5, "extreme_outlier").otherwise("ok")
    )
    return df.withColumn("robust_z", robust).withColumn("quality_flag", flag)


def cell_daily(cleaned: DataFrame) -> DataFrame:
    """One row for each cell, day and departure: usable quotes, their least, median and greatest price, and who reported."""
    ok = F.col("is_available") & (F.col("quality_flag") == "ok")
    fare = F.when(ok, F.col("total_fare"))
    seen = lambda c: F.count_distinct(F.when(F.col("is_available"), F.col(c)))
    return cleaned.groupBy("collection_date", "origin", "destination", "route", "lead_time_days", "dep_date").agg(
        F.count_if(ok).alias("usable_quotes"), seen("source").alias("sources_reporting"), seen("carrier").alias("carriers_reporting"),
        F.min(fare).alias("cheapest_fare"), F.percentile(fare, F.lit(0.5)).alias("median_fare"), F.max(fare).alias("dearest_fare"),
        F.bool_or("is_available").alias("cell_available"),
        F.count_if(F.col("unavailable_reason").isin(*C.MARKET_SIGNALS)).alias("sold_out_quotes"),
        F.count_if(F.col("unavailable_reason").isin(*C.FAILURES)).alias("failed_quotes"),
        F.count_if(F.col("quality_flag") == "extreme_outlier").alias("flagged_outliers"),
    )


def disallowed(robots_log: DataFrame) -> DataFrame:
    return robots_log.groupBy("run_id").agg(F.count_if(~F.col("allowed")).alias("robots_disallowed_paths"))


def seconds_between(a: str, b: str):
    """Whole seconds from a to b, rounded half up."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return F.round((micros(b) - micros(a)) / 1e6).cast("int")


def collection_health(cells: DataFrame, runs: DataFrame, robots_log: DataFrame) -> DataFrame:
    """For each day what its cells gave (over the cells seen), beside each of its runs."""
    day = cells.groupBy("collection_date").agg(
        F.count("*").alias("cells_in_basket"), F.count_if("cell_available").alias("cells_priced"), F.sum("usable_quotes").alias("usable_quotes"),
        F.sum("sold_out_quotes").alias("sold_out_quotes"), F.sum("failed_quotes").alias("failed_quotes"), F.sum("flagged_outliers").alias("flagged_outliers"),
    )
    day = day.withColumn("availability_rate", F.round(F.try_divide("cells_priced", "cells_in_basket"), 4))
    r = runs.join(disallowed(robots_log), "run_id", "left").select("collection_date", "run_id", "status", seconds_between("started_at_utc", "finished_at_utc").alias("duration_s"), F.coalesce("robots_disallowed_paths", F.lit(0)).cast("long").alias("robots_disallowed_paths"))
    return day.join(r, "collection_date", "left").withColumn("robots_disallowed_paths", F.coalesce("robots_disallowed_paths", F.lit(0).cast("long")))


def health_view(runs: DataFrame, robots_log: DataFrame) -> DataFrame:
    r = runs.join(disallowed(robots_log), "run_id", "left")
    return r.select("collection_date", "run_id", "status", "cells_expected", "cells_available", seconds_between("started_at_utc", "finished_at_utc").alias("duration_s"), F.coalesce("robots_disallowed_paths", F.lit(0)).cast("long").alias("robots_disallowed_paths"))
