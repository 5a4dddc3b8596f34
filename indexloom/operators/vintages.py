"""Published values keep all their vintages; a recomputation is a new row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["collection_date", "scenario", "series"]


def latest(values: DataFrame) -> DataFrame:
    """The newest vintage of each point: a maximum, combined before the shuffle."""
    rest = [c for c in values.columns if c not in KEY]
    best = values.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "computed_at_utc").alias("v"))
    return best.select(*KEY, "v.*")


def keep_latest(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """Of the rows of each key the one with the greatest value of `by`."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("v")).select(*key, *[F.col("v")[c].alias(c) for c in rest]).select(*rows.columns)


def numbered(values: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY)
    return values.withColumn("vintage_no", F.row_number().over(w.orderBy("computed_at_utc"))).withColumn("vintages", F.count("*").over(w))


def revisions(values: DataFrame) -> DataFrame:
    """Each vintage whose value differs from the one before it (nulls compare as values), by how much."""
    w = Window.partitionBy(*KEY).orderBy("computed_at_utc")
    n = values.select(*KEY, F.row_number().over(w).alias("from_vintage"), F.col("computed_at_utc").alias("first_computed_at"), F.col("index_value").alias("first_value"), F.lead("computed_at_utc").over(w).alias("later_computed_at"), F.lead("index_value").over(w).alias("later_value"))
    changed = n.where(F.col("later_computed_at").isNotNull() & ~F.col("first_value").eqNullSafe(F.col("later_value")))
    return changed.withColumn("to_vintage", F.col("from_vintage") + 1).withColumn("revision_points", F.round(F.col("later_value") - F.col("first_value"), 6))


def append_new(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing with the rows of new whose key and time it doesn't hold yet; nothing is overwritten."""
    return existing.unionByName(new.join(existing.select(*KEY, "computed_at_utc"), [*KEY, "computed_at_utc"], "left_anti"))


def upsert_runs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each run: the new one where there is one."""
    return existing.join(new.select("run_id"), "run_id", "left_anti").unionByName(new)


def replace_day(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Health entries by date: new days replace old ones."""
    return existing.join(new.select("collection_date").distinct(), "collection_date", "left_anti").unionByName(new, allowMissingColumns=True)
