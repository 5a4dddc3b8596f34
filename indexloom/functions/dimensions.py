"""Small dimension tables. Their sizes are fixed by the basket, so joins may broadcast them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions import constants as C


def routes(spark: SparkSession) -> DataFrame:
    """route_id, origin, destination, pair (unordered), pax and weight (share of all passengers)."""
    total = sum(p for _, _, p in C.ROUTES)
    rows = [(i, o, d, "-".join(sorted((o, d))), p, p / total) for i, (o, d, p) in enumerate(C.ROUTES)]
    return spark.createDataFrame(rows, "route_id int, origin string, destination string, pair string, pax double, weight double")


def scenarios(spark: SparkSession) -> DataFrame:
    rows = [(s, lead, w) for s, ws in C.SCENARIOS.items() for lead, w in ws.items()]
    return spark.createDataFrame(rows, "scenario string, lead_time_days int, lead_weight double")


def check_scenarios(table: dict[str, dict[int, float]] | None = None) -> None:
    """Each scenario weighs exactly the lead times, and its weights sum to one."""
    for name, weights in (table or C.SCENARIOS).items():
        if set(weights) != set(C.LEAD_TIMES):
            raise ValueError(f"scenario {name} must weigh exactly {C.LEAD_TIMES}")
        if abs(sum(weights.values()) - 1.0) > 1e-9:
            raise ValueError(f"weights of scenario {name} don't sum to 1")


def scenario(name: str) -> dict[int, float]:
    if name not in C.SCENARIOS:
        raise KeyError(f"unknown scenario {name!r}; there are {sorted(C.SCENARIOS)}")
    return C.SCENARIOS[name]


def basket_weights(route_weights: DataFrame, scenario_weights: DataFrame) -> DataFrame:
    """scenario x route x lead time with the product of the weights (at most a few thousand rows)."""
    return scenario_weights.crossJoin(F.broadcast(route_weights.select("origin", "destination", "weight"))).select("scenario", *C.STRATUM_KEY, (F.col("weight") * F.col("lead_weight")).alias("weight"))


def check_basket(weights: DataFrame) -> None:
    """Raises unless each scenario's weights sum to one."""
    bad = weights.groupBy("scenario").agg(F.sum("weight").alias("total")).where(F.abs(F.col("total") - 1) > 1e-8).collect()
    if bad:
        raise ValueError(f"basket weights don't sum to 1: {bad}")


def cells_on(days: DataFrame) -> DataFrame:
    """The basket's cells on every collection day of `days` (collection_date): each route at each lead time, with its departure date and label."""
    spark = days.sparkSession
    basket = routes(spark).select("origin", "destination").withColumn("lead_time_days", F.explode(F.array(*map(F.lit, C.LEAD_TIMES))))  # 120 rows
    out = days.crossJoin(F.broadcast(basket)).select("origin", "destination", "lead_time_days", "collection_date")
    return out.withColumn("dep_date", F.date_add("collection_date", F.col("lead_time_days"))).withColumn("cell", cell_label())


def cells(spark: SparkSession, day: str) -> DataFrame:
    """The basket's cells on one collection day."""
    return cells_on(spark.createDataFrame([(day,)], "day string").select(F.col("day").cast("date").alias("collection_date")))


def cell_label():
    return F.format_string("%s->%s/T+%d", "origin", "destination", "lead_time_days")


def load_basket(path: str) -> dict:
    """A basket document (JSON, or YAML where a parser is installed), with its weights checked."""
    text = Path(path).read_text()
    try:
        basket = json.loads(text)
    except ValueError:
        import yaml

        basket = yaml.safe_load(text)
    if abs(sum(r["weight"] for r in basket["routes"]) - 1) > 1e-8:
        raise ValueError("route weights don't sum to 1")
    return basket
