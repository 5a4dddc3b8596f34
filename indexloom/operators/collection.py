"""What a collection run saw: outcomes of cells, counters of sources, robots decisions, health."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a bot wall in a fetched body and in a rendered page, and of an empty result. Fixed values.
WALL_MARKS = ["captcha", "recaptcha", "hcaptcha", "are you a human", "unusual traffic", "access denied", "request unsuccessful", "incapsula", "cf-challenge", "checking your browser", "px-captcha", "perimeterx", "datadome"]
PAGE_WALL_MARKS = ["captcha", "unusual traffic", "access denied", "checking your browser", "px-captcha"]
SOLD_OUT_MARKS = ["no flights found", "no flights available", "sold out", "no results", "we couldn't find any flights", "no direct flights", "0 flights", "try changing your search", "no matching flights"]


def _has(text: Column, marks: list[str], head: int | None) -> Column:
    low = F.lower(F.coalesce(text if head is None else F.substring(text, 1, head), F.lit("")))
    return reduce(or_, [low.contains(m) for m in marks])


def outcome(robots_allowed: Column, error: Column, page: Column, offers: Column, head: int | None = None) -> Column:
    """The reason recorded for a cell, null if it has offers. Order matters: robots, navigation, wall, offers, sold out, unread.

    `head` limits the search for marks to a page's first characters.
    """
    return (
        F.when(~robots_allowed, "robots_disallowed").when(F.lower(error).contains("timeout"), "timeout").when(error.isNotNull(), "parse_error").when(_has(page, PAGE_WALL_MARKS, head), "blocked")
        .when(offers > 0, F.lit(None)).when(_has(page, SOLD_OUT_MARKS, head), "sold_out").otherwise("parse_error")
    )


def fetched_reason(status: Column, body: Column, head: int | None = None) -> Column:
    """The reason recorded for a fetched body, null if it may be read: its status, or a wall."""
    return F.coalesce(status_reason(status), F.when(_has(body, WALL_MARKS, head), "blocked"))


def status_reason(status: Column) -> Column:
    return F.when(status.isin(403, 451), "blocked").when(status == 429, "rate_limited").when(status >= 500, "timeout").when(status >= 400, "parse_error")


def robots_decision(status: Column, parser_allows: Column) -> Column:
    """Fail closed: unreachable or refused means no; absent rules (404) mean yes; else what the rules say."""
    return F.when(status.isNull(), False).when(status == 404, True).when(status >= 400, False).otherwise(F.coalesce(parser_allows, F.lit(False)))


def counter_of(reason: Column) -> Column:
    """The counter that a reason adds to."""
    return F.when(reason.isin("sold_out", "no_service"), "sold_out").when(reason.isin("blocked", "robots_disallowed", "rate_limited"), "blocked").when(reason == "timeout", "timeout").when(reason == "parse_error", "parse_error")


def source_counters(quotes: DataFrame, cells_expected: int | None = None) -> DataFrame:
    """For each day and source: cells attempted and available, quotes, and failures by counter."""
    kind = counter_of(F.col("unavailable_reason"))
    cell = ["origin", "destination", "lead_time_days"]
    per_cell = quotes.withColumn("_k", kind).groupBy("collection_date", "source", *cell).agg(
        F.bool_or("is_available").alias("a"), F.count_if("is_available").alias("q"), *[F.bool_or(F.coalesce(F.col("_k") == k, F.lit(False))).alias("_" + k) for k in ("sold_out", "blocked", "timeout", "parse_error")]
    )
    out = per_cell.groupBy("collection_date", "source").agg(
        F.count("*").alias("cells_attempted"), F.count_if("a").alias("cells_available"), F.sum("q").alias("quotes_written"), *[F.count_if("_" + k).alias(k + "_count") for k in ("sold_out", "blocked", "timeout", "parse_error")]
    )
    expected = F.lit(cells_expected) if cells_expected else F.col("cells_attempted")
    return out.withColumn("availability_rate", F.try_divide("cells_available", expected))


def availability_alarm(rates: DataFrame, floor: float = 0.8) -> DataFrame:
    return rates.where(F.col("availability_rate") < floor)


def stop_below(rates: DataFrame, floor: float = 0.8) -> None:
    bad = availability_alarm(rates, floor).limit(5).collect()
    if bad:
        raise RuntimeError(f"availability below {floor}: {bad}")


def health_status(last_date: Column, rate: Column, today: Column) -> Column:
    age = F.datediff(today, last_date)
    return F.when((age <= 1) & (rate >= 0.8), "healthy").when(age <= 2, "degraded").otherwise("stale")


def long_counters(counters: DataFrame, names: list[str]) -> DataFrame:
    """Counters of each day and source as rows, for stacked charts."""
    return counters.unpivot(["collection_date", "source"], names, "counter", "n")


def explode_health(entries: DataFrame) -> DataFrame:
    """Health entries with a map per_source of counters, one row a source."""
    return entries.select("collection_date", F.explode("per_source").alias("source", "c")).select("collection_date", "source", "c.*")


def already_collected(recorded: DataFrame) -> DataFrame:
    """Source and cell of each row recorded; rows cut off in writing are skipped."""
    key = ["source", "origin", "destination", "lead_time_days"]
    return recorded.withColumn("lead_time_days", F.expr("try_cast(lead_time_days AS int)")).select(*key).dropna().dropDuplicates()


def still_to_collect(cells: DataFrame, recorded: DataFrame) -> DataFrame:
    return cells.join(already_collected(recorded), ["source", "origin", "destination", "lead_time_days"], "left_anti")


def cheapest_in_cell(offers: DataFrame, cell: list[str], order: str) -> DataFrame:
    """Flags the first of the cheapest offers of each cell; offers without a positive fare go."""
    from pyspark.sql import Window

    ok = offers.where(F.col("total_fare") > 0)
    return ok.withColumn("is_cheapest_in_cell", F.row_number().over(Window.partitionBy(*cell).orderBy("total_fare", order)) == 1)


def identified_first(offers: DataFrame) -> DataFrame:
    return offers.orderBy(F.col("carrier").isNull(), "total_fare")


def probe_score(fare_hits: Column, flight_hits: Column, values: Column, body_bytes: Column) -> Column:
    return F.least(fare_hits, F.lit(20)) + F.least(flight_hits, F.lit(20)) * 1.5 + values * 2 + F.when(body_bytes > 5000, 3).otherwise(0)


def top_endpoints(scored: DataFrame, n: int = 6) -> DataFrame:
    return scored.orderBy(F.desc("score"), "url").limit(n)


def probe_verdict(wall: Column, error: Column, endpoints: Column, values: Column) -> Column:
    """What a probe of a source found: a wall, an error, an endpoint with plausible fares, endpoints without, or none."""
    return F.when(wall, "bot_wall").when(error, "error").when((endpoints > 0) & (values > 0), "json_endpoint_found").when(endpoints > 0, "json_seen_no_fares").otherwise("no_json_fare_endpoint")
