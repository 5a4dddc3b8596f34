"""Chaining relatives to stratum levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indexloom.functions import constants as C


def chain(imputed: DataFrame, days: DataFrame, universe: DataFrame) -> DataFrame:
    """Levels of each stratum, 100 on the first day. A day without a donor has no level; later days go on from the level held."""
    w = Window.partitionBy(*C.STRATUM_KEY).orderBy("collection_date")
    level = C.BASE_VALUE * F.exp(F.coalesce(F.sum(F.log("relative_used")).over(w), F.lit(0.0)))
    later = imputed.select(*C.STRATUM_KEY, "collection_date", F.when(F.col("relative_used").isNotNull(), level).alias("stratum_index"), "imputation_tier", "matched_items")
    first = days.where("day_no = 1").select("collection_date")
    base = universe.crossJoin(F.broadcast(first)).select(
        *C.STRATUM_KEY, "collection_date", F.lit(C.BASE_VALUE).alias("stratum_index"), F.lit(C.TIER_OBSERVED).alias("imputation_tier"), F.lit(None).cast("long").alias("matched_items")
    )
    return base.unionByName(later)
