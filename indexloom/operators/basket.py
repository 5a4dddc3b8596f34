"""The basket from traffic: directed volumes, pairs, selection, coverage and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_label(c: str):
    """Upper case, white space (no-break spaces too) collapsed."""
    return F.trim(F.regexp_replace(F.upper(c), r"[\s ]+", " "))


def map_cities(traffic: DataFrame, cities: DataFrame) -> DataFrame:
    """Adds origin and destination codes of City1 and City2 from cities (city, code); null where unmapped."""
    c = cities.select(clean_label("city").alias("_c"), "code")  # Spark broadcasts it if its measured size allows
    a = traffic.join(c.withColumnRenamed("code", "origin"), clean_label("City1") == F.col("_c"), "left").drop("_c")
    return a.join(c.withColumnRenamed("code", "destination"), clean_label("City2") == F.col("_c"), "left").drop("_c")


def unmapped(traffic: DataFrame, cities: DataFrame) -> DataFrame:
    """Labels without a code and the passengers they carry."""
    labels = traffic.select(clean_label("City1").alias("label"), "PaxToCity2", "PaxFromCity2").unionByName(traffic.select(clean_label("City2").alias("label"), "PaxToCity2", "PaxFromCity2"))
    known = cities.select(clean_label("city").alias("label"))
    return labels.join(known, "label", "left_anti").groupBy("label").agg(F.sum(F.col("PaxToCity2") + F.col("PaxFromCity2")).alias("pax"))


def trailing(traffic: DataFrame, n: int = 12) -> DataFrame:
    """Rows of the last n distinct months."""
    with_month = traffic.withColumn("ym", F.col("Year") * 100 + F.col("Month"))
    last = with_month.select("ym").distinct().orderBy(F.desc("ym")).limit(n)
    return with_month.join(F.broadcast(last), "ym", "left_semi")


def directed_pax(mapped: DataFrame) -> DataFrame:
    """Passengers of each directed route, both directions of a row counted; routes to oneself go."""
    forth = mapped.select("origin", "destination", F.col("PaxToCity2").alias("pax"))
    back = mapped.select(F.col("destination").alias("origin"), F.col("origin").alias("destination"), F.col("PaxFromCity2").alias("pax"))
    both = forth.unionByName(back).where("origin is not null and destination is not null and origin <> destination")
    return both.groupBy("origin", "destination").agg(F.sum("pax").alias("pax"))


def pair_volume(directed: DataFrame) -> DataFrame:
    pair = F.concat_ws("-", F.least("origin", "destination"), F.greatest("origin", "destination"))
    return directed.groupBy(pair.alias("pair")).agg(F.sum("pax").alias("pax"))


def select_pairs(pairs: DataFrame, seeds: list[str], thin: list[str], size: int = 12) -> DataFrame:
    """Seeds first in their order, then reserved thin pairs, then the largest, until `size`; says why each is there.

    Seeds and thin pairs stay whether or not they have volume (pax is null without), so that `missing_routes` and `check_selection` can tell.
    """
    named = list(dict.fromkeys([*seeds, *thin]))
    rows = [(p, "seed", 0, seeds.index(p)) if p in seeds else (p, "thin", 1, thin.index(p)) for p in named]
    listed = pairs.sparkSession.createDataFrame(rows, "pair string, reason string, _p int, _s int")
    forced = listed.join(pairs, "pair", "left").select("pair", "pax", "reason", "_p", "_s")
    others = pairs.join(F.broadcast(listed.select("pair")), "pair", "left_anti").select("pair", "pax", F.lit("volume").alias("reason"), F.lit(2).alias("_p"), F.lit(0).alias("_s"))  # a list of a few pairs
    order = ["_p", "_s", F.desc("pax"), "pair"]
    top = forced.unionByName(others).orderBy(*order).limit(size)  # a top-k: no sort in one task
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("_p", "_s")


def check_selection(pairs: DataFrame, directed: DataFrame, size: int = 12) -> None:
    """Raises unless exactly `size` pairs were chosen and both of their directions have volume."""
    if (n := pairs.count()) != size:
        raise ValueError(f"{n} pairs instead of {size}")
    if gone := missing_routes(directed, pairs).collect():
        raise ValueError(f"chosen routes without volume: {gone}")


def basket_routes(directed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both directions of the chosen pairs with their weights."""
    d = directed.withColumn("pair", F.concat_ws("-", F.least("origin", "destination"), F.greatest("origin", "destination"))).join(F.broadcast(pairs.select("pair")), "pair", "left_semi")
    return d.withColumn("weight", F.col("pax") / F.sum("pax").over(Window.partitionBy()))  # at most twice the chosen pairs


def missing_routes(directed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Directions of chosen pairs that have no volume."""
    ends = pairs.select(F.split("pair", "-").alias("p"))
    want = ends.select(F.col("p")[0].alias("origin"), F.col("p")[1].alias("destination")).unionByName(ends.select(F.col("p")[1].alias("origin"), F.col("p")[0].alias("destination")))
    return want.join(directed, ["origin", "destination"], "left_anti")


def coverage(directed: DataFrame, pairs: DataFrame) -> DataFrame:
    d = directed.withColumn("pair", F.concat_ws("-", F.least("origin", "destination"), F.greatest("origin", "destination"))).join(F.broadcast(pairs.select("pair", F.lit(True).alias("_in"))), "pair", "left")
    return d.agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col("pax"))), F.lit(0.0)).alias("basket_pax"), F.sum("pax").alias("network_pax")).withColumn("share", F.try_divide("basket_pax", "network_pax"))


def weight_drift(frozen: DataFrame, fresh: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Routes that only one side has, or whose weights, to eight places, differ by more than the tolerance."""
    j = frozen.select("origin", "destination", F.round("weight", 8).alias("frozen")).join(fresh.select("origin", "destination", F.round("weight", 8).alias("fresh")), ["origin", "destination"], "full_outer")
    kind = F.when(F.col("fresh").isNull(), "missing").when(F.col("frozen").isNull(), "new").when(F.abs(F.col("frozen") - F.col("fresh")) > tolerance, "changed")
    return j.withColumn("kind", kind).where("kind is not null")
