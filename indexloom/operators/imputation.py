"""Missing relatives are filled from the movement of others on the same day, never from old prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions import constants as C

TIERS = [C.TIER_OBSERVED, C.TIER_ROUTE, C.TIER_LEAD, C.TIER_ALL, C.TIER_NONE]


def impute(relatives: DataFrame) -> DataFrame:
    """Adds relative_used and imputation_tier: own relative, else the day's route, lead time or all-items movement."""
    log = F.when(F.col("relative") > 0, F.log("relative"))
    movement = lambda *keys: F.exp(F.avg(log).over(Window.partitionBy("collection_date", *keys)))
    df = relatives.withColumn("_route", movement("origin", "destination")).withColumn("_lead", movement("lead_time_days")).withColumn("_all", movement())
    tier = (
        F.when(F.col("relative").isNotNull(), C.TIER_OBSERVED).when(F.col("_route").isNotNull(), C.TIER_ROUTE).when(F.col("_lead").isNotNull(), C.TIER_LEAD)
        .when(F.col("_all").isNotNull(), C.TIER_ALL).otherwise(C.TIER_NONE)
    )
    return df.withColumn("relative_used", F.coalesce("relative", "_route", "_lead", "_all")).withColumn("imputation_tier", tier).drop("_route", "_lead", "_all")


def summary(imputed: DataFrame) -> DataFrame:
    """For each day the number of strata in each tier and the observed share."""
    counts = [F.count_if(F.col("imputation_tier") == t).alias(t) for t in TIERS]
    return imputed.groupBy("collection_date").agg(*counts, F.count("*").alias("n_strata")).withColumn("observed_share", F.col(C.TIER_OBSERVED) / F.col("n_strata"))
