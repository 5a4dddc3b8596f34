"""A basket frozen as CSV, JSON and YAML, and the tree of hashes that tells whether it is still the same.

Every route is a leaf: the SHA-256 of its values in one canonical text (numbers with fixed decimals,
each value with its length before it). Leaves of one origin make a branch, branches the root, each over names and
hashes in order. The three files hold the same routes and the root, so each of them can be read back and checked,
and a basket computed again differs in the leaves of exactly those routes that changed. A basket is a
small table, of some dozens of routes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.sources import by_header, sinks

ROUTE = "origin string, destination string, pair string, pax decimal(20,2), weight decimal(10,8)"
_NAMES = ["origin", "destination", "pair", "pax", "weight"]


def canonical(routes: DataFrame) -> DataFrame:
    """Routes with the types that are frozen: passengers to two places, weights to eight."""
    return routes.select("origin", "destination", "pair", F.col("pax").cast("decimal(20,2)").alias("pax"), F.col("weight").cast("decimal(10,8)").alias("weight"))


def leaves(routes: DataFrame) -> DataFrame:
    """(origin, destination, sha256) of every route."""
    return canonical(routes).select("origin", "destination", F.sha2(sinks.encoded(_NAMES), 256).alias("sha256"))


def _over(named: DataFrame, by: list[str], name: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "sha256")))
    return named.groupBy(*by).agg(F.sha2(F.array_join(F.transform(pairs, lambda x: F.concat(F.length(x["name"]).cast("string"), F.lit(":"), x["name"], x.sha256)), ""), 256).alias("sha256"))


def branches(routes: DataFrame) -> DataFrame:
    """(origin, sha256) over the routes of every origin."""
    return _over(leaves(routes), ["origin"], "destination")


def root(routes: DataFrame) -> DataFrame:
    """(sha256) over all origins; one row, also for no routes."""
    return _over(branches(routes), [], "origin")


def freeze(routes: DataFrame, folder: str, version: int) -> str:
    """Writes the basket into folder/csv, /json and /yaml, none of which may be there yet, and returns its root."""
    rows = canonical(routes).persist()  # a basket: some dozens of rows
    top = root(rows).first().sha256
    ordered = rows.orderBy("origin", "destination").coalesce(1)
    ordered.withColumn("basket_sha256", F.lit(top)).write.mode("errorifexists").option("header", True).csv(f"{folder}/csv")
    texts = F.struct(*[F.col(c).cast("string").alias(c) for c in _NAMES])
    listed = rows.agg(F.array_sort(F.collect_list(texts)).alias("routes"))  # one basket
    listed.select(F.lit(version).alias("version"), F.lit(top).alias("basket_sha256"), "routes").write.mode("errorifexists").json(f"{folder}/json")
    lines = F.concat(F.array(F.lit(f"version: {version:d}"), F.lit(f"basket_sha256: {top}"), F.lit("routes:")), F.transform("routes", lambda r: F.concat(F.lit("  - "), F.to_json(r))))
    listed.select(F.array_join(lines, "\n").alias("value")).write.mode("errorifexists").text(f"{folder}/yaml")
    rows.unpersist()
    return top


def read_frozen(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The routes of a frozen basket, with the root that its file holds in basket_sha256."""
    if kind == "csv":
        return by_header.read(spark, f"{folder}/csv", f"{ROUTE}, basket_sha256 string")
    if kind == "json":
        rows = spark.read.schema("version int, basket_sha256 string, routes array<struct<origin:string,destination:string,pair:string,pax:string,weight:string>>").json(f"{folder}/json")
        rows = rows.select("basket_sha256", F.explode("routes").alias("r"))
    elif kind == "yaml":
        lines = spark.read.text(f"{folder}/yaml", wholetext=True).select(F.regexp_extract("value", r"(?m)^basket_sha256: (\w+)$", 1).alias("basket_sha256"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^  - (\{.*\})$"))).alias("line"))
        rows = lines.select("basket_sha256", F.from_json("line", "origin string, destination string, pair string, pax string, weight string").alias("r"))
    else:
        raise ValueError(f"a basket is frozen as csv, json or yaml, not {kind!r}")
    return rows.select("r.origin", "r.destination", "r.pair", F.col("r.pax").cast("decimal(20,2)").alias("pax"), F.col("r.weight").cast("decimal(10,8)").alias("weight"), "basket_sha256")


def check_frozen(frozen: DataFrame) -> str:
    """The root of a frozen basket, if it is the one that its file holds; an error otherwise."""
    held = [r[0] for r in frozen.select("basket_sha256").distinct().limit(2).collect()]
    top = root(frozen).first().sha256
    if held != [top]:
        raise ValueError(f"the frozen basket isn't what it was: {top} instead of {held}")
    return top


def drifted(frozen: DataFrame, fresh: DataFrame) -> DataFrame:
    """(origin, destination, kind): routes that are missing, new or changed; none if the roots are the same."""
    j = leaves(frozen).withColumnRenamed("sha256", "a").join(leaves(fresh).withColumnRenamed("sha256", "b"), ["origin", "destination"], "full_outer")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return j.select("origin", "destination", kind.alias("kind")).where("kind is not null")
