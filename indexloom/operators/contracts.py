"""Contracts: every rule gives the rows that break it, so a run can list all of them or stop on any."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.sources import store


def quote_rules(columns: list[str], currency: str = "INR") -> dict[str, Column]:
    """name -> condition that holds for a good row (null counts as broken)."""
    ok, fare = F.col("is_available"), F.col("total_fare")
    reasons = [*C.MARKET_SIGNALS, *C.FAILURES]
    rules = {
        "collection_date": F.col("collection_date").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "source": F.col("source").isNotNull(),
        "origin": F.col("origin").rlike("^[A-Z]{3}$"),
        "destination": F.col("destination").rlike("^[A-Z]{3}$"),
        "lead_time_days": F.col("lead_time_days").isin(*C.LEAD_TIMES),
        "currency": F.col("currency") == currency,
        "available_is_priced": ~ok | (fare.isNotNull() & fare.between(*C.CONTRACT_FARES)),
        "not_to_itself": F.col("origin") != F.col("destination"),
        "departs_after_lead_time": F.datediff("dep_date", "collection_date") == F.col("lead_time_days"),
    }
    if "unavailable_reason" in columns:
        rules["unavailable_has_reason"] = ok | F.col("unavailable_reason").isin(*reasons)
    return rules


def index_rules() -> dict[str, Column]:
    unit = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    return {
        "index_value": (F.col("index_value") > 0) & (F.col("index_value") <= 10_000),
        "scenario": F.col("scenario").isin(*C.SCENARIOS),
        "availability_rate": F.col("availability_rate").isNotNull() & unit("availability_rate"),
        "observed_weight_share": unit("observed_weight_share"),
    }


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each broken rule of each row, in one pass: column `rule` beside the row's own."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule (zero included)."""
    agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return agg.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(n) for n in rules]))).alias("rule", "broken"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def accepted_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).between(low, high))


def enforce(df: DataFrame, rules: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """df itself, or an error that names every broken rule and how often it is broken."""
    found = [(r.rule, r.broken) for r in counts(df, rules).where("broken > 0").collect()]  # one row a rule
    if keys and (n := duplicates(df, keys).count()):
        found.append((f"unique {'+'.join(keys)}", n))
    if found:
        raise ValueError("contract broken: " + ", ".join(f"{r} ({n})" for r, n in sorted(found)))
    return df


def measures(rules: dict[str, Column], more: dict[str, Column] | None = None) -> dict[str, Column]:
    """Aggregates that tell of a contract while rows pass: how many there are and how many break each rule, and whatever more is asked for."""
    return {"rows": F.count(F.lit(1)), **{f"broken_{n}": F.count_if(~F.coalesce(c, F.lit(False))) for n, c in rules.items()}, **(more or {})}


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], more: dict[str, Column] | None = None, judge: Callable[[dict], None] | None = None) -> DataFrame:
    """Writes df as Parquet and returns it reread, if no row breaks a rule and `judge` takes the other measures.

    The rows are read once: what is written is measured on its way. It is written beside `path`, which it
    gets only when it holds; otherwise it is dropped and the error names every broken rule.
    """
    spark, staged, seen = df.sparkSession, f"{path}.staged", Observation()
    df.observe(seen, *[c.alias(n) for n, c in measures(rules, more).items()]).write.mode("overwrite").parquet(staged)
    try:
        found = seen.get
        if broken := sorted((n.removeprefix("broken_"), found[n]) for n in found if n.startswith("broken_") and found[n]):
            raise ValueError("contract broken: " + ", ".join(f"{r} ({n})" for r, n in broken))
        if judge:
            judge(found)
        store.rename(spark, staged, path)
    except BaseException:
        store.drop(spark, staged)
        raise
    return spark.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns found by name; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
