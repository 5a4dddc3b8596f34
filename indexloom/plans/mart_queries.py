"""Queries of the marts, vintages, basket, contracts, diagnostics and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.functions import dimensions, fares, urls
from indexloom.operators import aggregate, basket, collection, contracts, diagnostics, elementary, hedonic, imputation, quality, vintages
from indexloom.operators import offers as offer_rows
from indexloom.plans.index_build import build
from indexloom.plans.index_queries import QUERIES, QUERY_SQL, query, rounded
from indexloom.sources import offers, sinks
from indexloom.sources.quotes import quotes_from_events

# --- the raw table of these queries: quotes at a hundredfold price, with flight numbers and departures -------------

RAW = {
    "raw": """SELECT q.quote_id, q.collection_ts_utc, q.collection_date, q.source, q.origin, q.destination, q.lead_time_days, q.carrier, q.carrier || CAST(q.quote_id % 3 AS VARCHAR) AS flight_no,
        CASE WHEN q.is_available THEN round(q.total_fare * 100, 0) END AS total_fare, q.is_available, q.unavailable_reason, CAST(q.collection_date + CAST(q.lead_time_days AS INTEGER) + CASE WHEN q.quote_id % 97 = 0 THEN 1 ELSE 0 END AS DATE) AS dep_date,
        q.collection_ts_utc + to_days(CAST(q.lead_time_days AS INTEGER)) AS dep_ts FROM quotes q""",
    "staged": """SELECT *, collection_ts_utc + INTERVAL 330 MINUTE AS collection_ts_ist, origin || '-' || destination AS route, date_diff('day', collection_date, dep_date) AS observed_lead_days, dep_ts + INTERVAL 330 MINUTE AS dep_ts_ist,
        dayofweek(dep_ts + INTERVAL 330 MINUTE) AS dep_dow, hour(dep_ts + INTERVAL 330 MINUTE) AS dep_hour
        FROM (SELECT *, row_number() OVER (PARTITION BY collection_date, source, origin, destination, lead_time_days, coalesce(carrier, ''), coalesce(flight_no, '') ORDER BY collection_ts_utc, quote_id) AS rn FROM raw) WHERE rn = 1""",
    "medians": "SELECT route, lead_time_days, quantile_cont(total_fare, 0.5) AS median_fare, count(*) AS n_observations FROM staged WHERE is_available AND total_fare IS NOT NULL GROUP BY ALL",
    "stats": "SELECT m.route, m.lead_time_days, m.median_fare, m.n_observations, quantile_cont(abs(s.total_fare - m.median_fare), 0.5) AS mad_fare FROM medians m JOIN staged s ON s.route = m.route AND s.lead_time_days = m.lead_time_days WHERE s.is_available AND s.total_fare IS NOT NULL GROUP BY ALL",
    "cleaned": """SELECT s.*, r.median_fare, r.mad_fare, r.n_observations, CASE WHEN NOT s.is_available THEN NULL WHEN coalesce(r.mad_fare, 0) = 0 THEN 0 ELSE round(0.6745 * (s.total_fare - r.median_fare) / r.mad_fare, 3) + 0 END AS robust_z,
        CASE WHEN NOT s.is_available THEN 'unavailable' WHEN s.total_fare IS NULL THEN 'no_price' WHEN s.total_fare < 800 THEN 'implausibly_low' WHEN s.total_fare > 150000 THEN 'implausibly_high' WHEN s.observed_lead_days <> s.lead_time_days THEN 'lead_time_mismatch'
        WHEN r.mad_fare > 0 AND abs(0.6745 * (s.total_fare - r.median_fare) / r.mad_fare) > 5 THEN 'extreme_outlier' ELSE 'ok' END AS quality_flag
        FROM staged s LEFT JOIN stats r ON r.route = s.route AND r.lead_time_days = s.lead_time_days""",
    "cells": f"""SELECT collection_date, origin, destination, route, lead_time_days, dep_date, count(*) FILTER (WHERE is_available AND quality_flag = 'ok') AS usable_quotes, count(DISTINCT source) FILTER (WHERE is_available) AS sources_reporting,
        count(DISTINCT carrier) FILTER (WHERE is_available) AS carriers_reporting, min(total_fare) FILTER (WHERE is_available AND quality_flag = 'ok') AS cheapest_fare, quantile_cont(total_fare, 0.5) FILTER (WHERE is_available AND quality_flag = 'ok') AS median_fare,
        max(total_fare) FILTER (WHERE is_available AND quality_flag = 'ok') AS dearest_fare, bool_or(is_available) AS cell_available, count(*) FILTER (WHERE unavailable_reason IN ('sold_out', 'no_service')) AS sold_out_quotes,
        count(*) FILTER (WHERE unavailable_reason IN ({', '.join(f"'{x}'" for x in C.FAILURES)})) AS failed_quotes, count(*) FILTER (WHERE quality_flag = 'extreme_outlier') AS flagged_outliers FROM cleaned GROUP BY ALL""",
    "runs": """SELECT 'run-' || CAST(n AS VARCHAR) || '-' || CAST(collection_date AS VARCHAR) AS run_id, collection_date, CASE WHEN day_no % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(120 AS BIGINT) AS cells_expected, CAST(120 - day_no AS BIGINT) AS cells_available,
        CAST(collection_date AS TIMESTAMP) AS started_at_utc, CAST(collection_date AS TIMESTAMP) + to_milliseconds(61701 * CAST(day_no AS BIGINT)) AS finished_at_utc FROM days CROSS JOIN (VALUES (1), (2)) v(n) WHERE n = 1 OR day_no % 5 = 0""",
    "robots": "SELECT 'run-1-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_id % 3 <> 0 AS allowed FROM events WHERE event_type = 'error'",
    "paths": "SELECT run_id, count(*) FILTER (WHERE NOT allowed) AS robots_disallowed_paths FROM robots GROUP BY run_id",
    "index_values": "SELECT CAST(ts AS DATE) AS collection_date, event_type AS scenario, 'headline' AS series, ts AS computed_at_utc, CASE WHEN event_id % 11 = 0 THEN NULL ELSE round(value, 1) END AS index_value FROM events",
    "vintages": "SELECT *, row_number() OVER (PARTITION BY collection_date, scenario, series ORDER BY computed_at_utc) AS vintage_no FROM index_values",
    "traffic": """SELECT nc.n_name AS City1, ns.n_name AS City2, l.l_quantity AS PaxToCity2, CAST(l.l_linenumber AS DOUBLE) AS PaxFromCity2, year(o.o_orderdate) AS Year, month(o.o_orderdate) AS Month
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation nc ON nc.n_nationkey = c.c_nationkey JOIN nation ns ON ns.n_nationkey = s.s_nationkey""",
    "recent": "SELECT *, Year * 100 + Month AS ym FROM traffic WHERE Year * 100 + Month IN (SELECT DISTINCT Year * 100 + Month AS m FROM traffic ORDER BY m DESC LIMIT 12)",
    "codes": "SELECT n_name AS city, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code FROM nation WHERE n_nationkey % 9 <> 8",
    "mapped": "SELECT t.*, n1.code AS origin, n2.code AS destination FROM recent t LEFT JOIN codes n1 ON n1.city = t.City1 LEFT JOIN codes n2 ON n2.city = t.City2",
    "directed": "SELECT origin, destination, sum(pax) AS pax FROM (SELECT origin, destination, PaxToCity2 AS pax FROM mapped UNION ALL SELECT destination, origin, PaxFromCity2 FROM mapped) WHERE origin IS NOT NULL AND destination IS NOT NULL AND origin <> destination GROUP BY ALL",
    "pairs": "SELECT least(origin, destination) || '-' || greatest(origin, destination) AS pair, sum(pax) AS pax FROM directed GROUP BY 1",
    "forced": "SELECT * FROM (VALUES ('N01-N02', 'seed', 0, 1), ('N03-N04', 'seed', 0, 2), ('N05-N06', 'seed', 0, 3), ('N07-N09', 'thin', 1, 1)) v(pair, reason, p, s)",
    "chosen": """SELECT pair, pax, reason, row_number() OVER (ORDER BY p, s, pax DESC, pair) AS place FROM
        (SELECT f.pair, v.pax, f.reason, f.p, f.s FROM forced f LEFT JOIN pairs v ON v.pair = f.pair UNION ALL SELECT pair, pax, 'volume', 2, 0 FROM pairs WHERE pair NOT IN (SELECT pair FROM forced)) QUALIFY place <= 12""",
    "in_basket": "SELECT d.*, c.pair FROM directed d JOIN chosen c ON c.pair = least(d.origin, d.destination) || '-' || greatest(d.origin, d.destination)",
}
SEEDS, THIN = ["N01-N02", "N03-N04", "N05-N06"], ["N07-N09"]


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    q = quotes_from_events(spark, sf)
    shift = F.when(F.col("quote_id") % 97 == 0, 1).otherwise(0)
    return (
        q.withColumn("flight_no", F.concat("carrier", (F.col("quote_id") % 3).cast("string")))
        .withColumn("total_fare", F.when(F.col("is_available"), F.round(F.col("total_fare") * 100, 0)))
        .withColumn("dep_date", F.date_add("collection_date", F.col("lead_time_days") + shift))
        .withColumn("dep_ts", F.col("collection_ts_utc") + F.make_dt_interval(F.col("lead_time_days")))
    )


def _cleaned(spark, sf):
    return quality.clean(quality.stage(_raw(spark, sf)))


@query("staged_quotes", "SELECT quote_id, route, lead_time_days, CAST(observed_lead_days AS INTEGER) AS observed_lead_days, collection_ts_ist, dep_ts_ist, CAST(dep_dow AS INTEGER) AS dep_dow, CAST(dep_hour AS INTEGER) AS dep_hour, total_fare FROM staged", RAW)
def staged_quotes(spark, sf):
    return quality.stage(_raw(spark, sf)).select("quote_id", "route", "lead_time_days", "observed_lead_days", "collection_ts_ist", "dep_ts_ist", "dep_dow", "dep_hour", "total_fare")


@query("route_stats", "SELECT route, lead_time_days, median_fare, n_observations, mad_fare FROM stats", RAW)
def route_stats(spark, sf):
    return quality.route_stats(quality.stage(_raw(spark, sf)))


@query("clean_quotes", "SELECT quote_id, route, lead_time_days, total_fare, median_fare, mad_fare, n_observations, robust_z, quality_flag FROM cleaned", RAW)
def clean_quotes(spark, sf):
    return _cleaned(spark, sf).select("quote_id", "route", "lead_time_days", "total_fare", "median_fare", "mad_fare", "n_observations", "robust_z", "quality_flag")


@query("mart_cell_daily", "SELECT * FROM cells", RAW)
def mart_cell_daily(spark, sf):
    return quality.cell_daily(_cleaned(spark, sf))


def _runs(spark, sf):
    days = build(quotes_from_events(spark, sf)).days
    n = spark.createDataFrame([(1,), (2,)], "n int")
    start = F.col("collection_date").cast("timestamp_ntz")
    r = days.crossJoin(n).where("n = 1 or day_no % 5 = 0")
    return r.select(
        F.concat(F.lit("run-"), F.col("n").cast("string"), F.lit("-"), F.col("collection_date").cast("string")).alias("run_id"), "collection_date", F.when(F.col("day_no") % 7 == 0, "failed").otherwise("ok").alias("status"),
        F.lit(120).cast("long").alias("cells_expected"), (120 - F.col("day_no")).cast("long").alias("cells_available"), start.alias("started_at_utc"), (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("day_no") * F.lit(61.701).cast("decimal(18,6)"))).alias("finished_at_utc"),
    )


def _robots(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'")
    return e.select(F.concat(F.lit("run-1-"), F.to_date("ts").cast("string")).alias("run_id"), (F.col("event_id") % 3 != 0).alias("allowed"))


@query(
    "mart_collection_health",
    """SELECT c.*, r.run_id, r.status, CAST(round(epoch(r.finished_at_utc - r.started_at_utc)) AS INTEGER) AS duration_s, coalesce(p.robots_disallowed_paths, 0) AS robots_disallowed_paths FROM
    (SELECT collection_date, count(*) AS cells_in_basket, count(*) FILTER (WHERE cell_available) AS cells_priced, CAST(sum(usable_quotes) AS BIGINT) AS usable_quotes, CAST(sum(sold_out_quotes) AS BIGINT) AS sold_out_quotes, CAST(sum(failed_quotes) AS BIGINT) AS failed_quotes, CAST(sum(flagged_outliers) AS BIGINT) AS flagged_outliers,
    round(count(*) FILTER (WHERE cell_available) / count(*)::DOUBLE, 4) AS availability_rate FROM cells GROUP BY 1) c LEFT JOIN runs r ON r.collection_date = c.collection_date LEFT JOIN paths p ON p.run_id = r.run_id""",
    RAW,
)
def mart_collection_health(spark, sf):
    return quality.collection_health(quality.cell_daily(_cleaned(spark, sf)), _runs(spark, sf), _robots(spark, sf))


@query("health_view", "SELECT r.collection_date, r.run_id, r.status, r.cells_expected, r.cells_available, CAST(round(epoch(r.finished_at_utc - r.started_at_utc)) AS INTEGER) AS duration_s, coalesce(p.robots_disallowed_paths, 0) AS robots_disallowed_paths FROM runs r LEFT JOIN paths p ON p.run_id = r.run_id", RAW)
def health_view(spark, sf):
    return quality.health_view(_runs(spark, sf), _robots(spark, sf))


def _index_values(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.to_date("ts").alias("collection_date"), F.col("event_type").alias("scenario"), F.lit("headline").alias("series"), F.col("ts").alias("computed_at_utc"), F.when(F.col("event_id") % 11 != 0, F.round("value", 1)).alias("index_value"))


@query("index_latest", "SELECT collection_date, scenario, series, computed_at_utc, index_value FROM index_values QUALIFY row_number() OVER (PARTITION BY collection_date, scenario, series ORDER BY computed_at_utc DESC) = 1", RAW)
def index_latest(spark, sf):
    return vintages.latest(_index_values(spark, sf))


@query("index_vintages", "SELECT collection_date, scenario, series, computed_at_utc, index_value, vintage_no, count(*) OVER (PARTITION BY collection_date, scenario, series) AS vintages FROM vintages", RAW)
def index_vintages(spark, sf):
    return vintages.numbered(_index_values(spark, sf)).withColumn("vintage_no", F.col("vintage_no").cast("long"))


@query(
    "index_revisions",
    """SELECT a.collection_date, a.scenario, a.series, CAST(a.vintage_no AS INTEGER) AS from_vintage, a.computed_at_utc AS first_computed_at, a.index_value AS first_value, CAST(b.vintage_no AS INTEGER) AS to_vintage, b.computed_at_utc AS later_computed_at, b.index_value AS later_value, round(b.index_value - a.index_value, 6) AS revision_points
    FROM vintages a JOIN vintages b ON a.collection_date = b.collection_date AND a.scenario = b.scenario AND a.series = b.series AND b.vintage_no = a.vintage_no + 1 WHERE a.index_value IS DISTINCT FROM b.index_value""",
    RAW,
)
def index_revisions(spark, sf):
    return vintages.revisions(_index_values(spark, sf))


@query("append_vintage", "SELECT collection_date, scenario, series, computed_at_utc, index_value FROM index_values", RAW)
def append_vintage(spark, sf):
    """Half of the values are there, all are offered again: each is kept once."""
    v = _index_values(spark, sf)
    return vintages.append_new(v.where("hour(computed_at_utc) < 12"), v)


# --- basket -------------------------------------------------------------------------------------------------------


def _traffic(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    n = t("nation")
    names = lambda k: F.broadcast(n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias("City" + k[-1])))
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.join(names("k1"), F.col("c_nationkey") == F.col("k1")).join(names("k2"), F.col("s_nationkey") == F.col("k2"))
    return j.select("City1", "City2", F.col("l_quantity").alias("PaxToCity2"), F.col("l_linenumber").cast("double").alias("PaxFromCity2"), F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month"))


def _codes(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey % 9 <> 8").select(F.col("n_name").alias("city"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"))


def _directed(spark, sf):
    return basket.directed_pax(basket.map_cities(basket.trailing(_traffic(spark, sf)), _codes(spark, sf)))


@query("trailing_traffic", "SELECT CAST(ym AS INTEGER) AS ym, count(*) AS n, sum(PaxToCity2) AS pax FROM recent GROUP BY ym", RAW)
def trailing_traffic(spark, sf):
    return basket.trailing(_traffic(spark, sf)).groupBy("ym").agg(F.count("*").alias("n"), F.sum("PaxToCity2").alias("pax"))


@query("unmapped_cities", "SELECT label, sum(pax) AS pax FROM (SELECT City1 AS label, PaxToCity2 + PaxFromCity2 AS pax FROM recent UNION ALL SELECT City2, PaxToCity2 + PaxFromCity2 FROM recent) WHERE label NOT IN (SELECT city FROM codes) GROUP BY label", RAW)
def unmapped_cities(spark, sf):
    return basket.unmapped(basket.trailing(_traffic(spark, sf)), _codes(spark, sf))


@query("directed_pax", "SELECT * FROM directed", RAW)
def directed_pax(spark, sf):
    return _directed(spark, sf)


@query("pair_volume", "SELECT * FROM pairs", RAW)
def pair_volume(spark, sf):
    return basket.pair_volume(_directed(spark, sf))


@query("basket_pairs", "SELECT pair, pax, reason, place FROM chosen", RAW)
def basket_pairs(spark, sf):
    return basket.select_pairs(basket.pair_volume(_directed(spark, sf)), SEEDS, THIN).withColumn("place", F.col("place").cast("long"))


@query("basket_routes", "SELECT pair, origin, destination, pax, round(pax / sum(pax) OVER (), 9) AS weight FROM in_basket", RAW)
def basket_routes(spark, sf):
    d = _directed(spark, sf)
    return rounded(basket.basket_routes(d, basket.select_pairs(basket.pair_volume(d), SEEDS, THIN)), "weight", places=9)


@query("basket_coverage", "SELECT (SELECT coalesce(sum(pax), 0) FROM in_basket) AS basket_pax, sum(pax) AS network_pax, round((SELECT coalesce(sum(pax), 0) FROM in_basket) / sum(pax), 9) AS share FROM directed", RAW)
def basket_coverage(spark, sf):
    d = _directed(spark, sf)
    return rounded(basket.coverage(d, basket.select_pairs(basket.pair_volume(d), SEEDS, THIN)), "share", places=9)


@query("missing_routes", "SELECT w.origin, w.destination FROM (SELECT split_part(pair, '-', 1) AS origin, split_part(pair, '-', 2) AS destination FROM chosen UNION ALL SELECT split_part(pair, '-', 2), split_part(pair, '-', 1) FROM chosen) w ANTI JOIN directed d ON d.origin = w.origin AND d.destination = w.destination", RAW)
def missing_routes(spark, sf):
    d = _directed(spark, sf)
    return basket.missing_routes(d, basket.select_pairs(basket.pair_volume(d), SEEDS, THIN))


_SEEDED = """SELECT pair FROM (SELECT f.pair, p.pax, 0 AS o, f.s FROM (VALUES ('N01-N02', 1), ('N08-N09', 2)) f(pair, s) LEFT JOIN pairs p ON p.pair = f.pair
        UNION ALL SELECT pair, pax, 1, 0 FROM pairs WHERE pair NOT IN ('N01-N02', 'N08-N09')) QUALIFY row_number() OVER (ORDER BY o, s, pax DESC, pair) <= 12"""


@query("missing_seed_routes", f"SELECT w.origin, w.destination FROM (SELECT split_part(pair, '-', 1) AS origin, split_part(pair, '-', 2) AS destination FROM ({_SEEDED}) UNION ALL SELECT split_part(pair, '-', 2), split_part(pair, '-', 1) FROM ({_SEEDED})) w ANTI JOIN directed d ON d.origin = w.origin AND d.destination = w.destination", RAW)
def missing_seed_routes(spark, sf):
    """N08 is a city without a code: a seed with it has no volume, stays in the selection and is told."""
    d = _directed(spark, sf)
    return basket.missing_routes(d, basket.select_pairs(basket.pair_volume(d), ["N01-N02", "N08-N09"], []))


@query(
    "basket_drift",
    """SELECT coalesce(a.origin, b.origin) AS origin, coalesce(a.destination, b.destination) AS destination, a.w AS frozen, b.w AS fresh, CASE WHEN b.w IS NULL THEN 'missing' WHEN a.w IS NULL THEN 'new' ELSE 'changed' END AS kind
    FROM (SELECT origin, destination, round(pax / (SELECT sum(pax) FROM directed), 8) AS w FROM directed WHERE origin <> 'N01') a
    FULL JOIN (SELECT origin, destination, round(CASE WHEN origin = 'N02' THEN 2 ELSE 1 END * pax / (SELECT sum(pax) FROM directed), 8) AS w FROM directed WHERE origin <> 'N03') b ON a.origin = b.origin AND a.destination = b.destination
    WHERE a.w IS NULL OR b.w IS NULL OR abs(a.w - b.w) > 1e-9""",
    RAW,
)
def basket_drift(spark, sf):
    from pyspark.sql import Window

    d = _directed(spark, sf).withColumn("weight", F.col("pax") / F.sum("pax").over(Window.partitionBy()))
    fresh = d.where("origin <> 'N03'").withColumn("weight", F.when(F.col("origin") == "N02", 2 * F.col("weight")).otherwise(F.col("weight")))
    return basket.weight_drift(d.where("origin <> 'N01'"), fresh)


# --- contracts ----------------------------------------------------------------------------------------------------

_BAD = {
    "collection_date": "false", "source": "source IS NULL", "origin": "NOT regexp_full_match(origin, '[A-Z]{3}')", "destination": "NOT regexp_full_match(destination, '[A-Z]{3}')", "lead_time_days": "lead_time_days NOT IN (1, 7, 15, 30, 45)", "currency": "false",
    "available_is_priced": "is_available AND (total_fare IS NULL OR total_fare NOT BETWEEN 800 AND 150000)", "not_to_itself": "origin = destination", "departs_after_lead_time": "date_diff('day', collection_date, dep_date) <> lead_time_days",
    "unavailable_has_reason": "NOT is_available AND (unavailable_reason IS NULL OR unavailable_reason NOT IN ('sold_out', 'no_service', 'blocked', 'robots_disallowed', 'rate_limited', 'timeout', 'parse_error'))",
}


@query("quote_contract", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS broken FROM raw" for n, c in _BAD.items()), RAW)
def quote_contract(spark, sf):
    raw = _raw(spark, sf).withColumn("currency", F.lit("INR"))
    return contracts.counts(raw, contracts.quote_rules(raw.columns))


@query("quote_violations", " UNION ALL ".join(f"SELECT quote_id, '{n}' AS rule FROM raw WHERE {c}" for n, c in _BAD.items()), RAW)
def quote_violations(spark, sf):
    raw = _raw(spark, sf).withColumn("currency", F.lit("INR"))
    return contracts.violations(raw, contracts.quote_rules(raw.columns)).select("quote_id", "rule")


@query("index_contract", "SELECT 'index_value' AS rule, count(*) FILTER (WHERE NOT (index_value > 0 AND index_value <= 10000)) AS broken FROM published UNION ALL SELECT 'scenario', 0 UNION ALL SELECT 'availability_rate', count(*) FILTER (WHERE availability_rate IS NULL OR availability_rate NOT BETWEEN 0 AND 1) FROM published UNION ALL SELECT 'observed_weight_share', count(*) FILTER (WHERE observed_weight_share NOT BETWEEN 0 AND 1) FROM published")
def index_contract(spark, sf):
    return contracts.counts(aggregate.published(build(quotes_from_events(spark, sf)).points), contracts.index_rules())


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return contracts.duplicates(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query("accepted_values", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def accepted_values(spark, sf):
    return contracts.accepted_values(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("accepted_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 400000")
def accepted_range(spark, sf):
    return contracts.accepted_range(spark.read.parquet(f"{sf}/orders.parquet"), "o_totalprice", 1000, 400_000).select("o_orderkey", "o_totalprice")


# --- collection ---------------------------------------------------------------------------------------------------


@query(
    "source_counters",
    """SELECT collection_date, source, count(*) AS cells_attempted, count(*) FILTER (WHERE a) AS cells_available, CAST(sum(q) AS BIGINT) AS quotes_written, count(*) FILTER (WHERE s) AS sold_out_count, count(*) FILTER (WHERE b) AS blocked_count, count(*) FILTER (WHERE t) AS timeout_count, CAST(0 AS BIGINT) AS parse_error_count, round(count(*) FILTER (WHERE a) / 120.0::DOUBLE, 6) AS availability_rate
    FROM (SELECT collection_date, source, origin, destination, lead_time_days, bool_or(is_available) AS a, count(*) FILTER (WHERE is_available) AS q, bool_or(coalesce(unavailable_reason = 'sold_out', false)) AS s, bool_or(coalesce(unavailable_reason = 'blocked', false)) AS b, bool_or(coalesce(unavailable_reason = 'timeout', false)) AS t FROM quotes GROUP BY ALL) GROUP BY ALL""",
)
def source_counters(spark, sf):
    return rounded(collection.source_counters(quotes_from_events(spark, sf), 120), "availability_rate")


@query("counter_rows", "SELECT collection_date, 's' AS source, u.counter, u.n FROM (SELECT collection_date, count(DISTINCT (origin, destination, lead_time_days)) FILTER (WHERE unavailable_reason = 'sold_out') AS s, count(DISTINCT (origin, destination, lead_time_days)) FILTER (WHERE unavailable_reason = 'timeout') AS t FROM quotes GROUP BY 1) q CROSS JOIN LATERAL (SELECT 'sold_out_count' AS counter, q.s AS n UNION ALL SELECT 'timeout_count', q.t) u")
def counter_rows(spark, sf):
    return collection.long_counters(collection.source_counters(quotes_from_events(spark, sf)), ["sold_out_count", "timeout_count"])


@query("availability_alarm", "SELECT collection_date, round(availability_rate, 6) AS availability_rate FROM availability WHERE availability_rate < 0.8")
def availability_alarm(spark, sf):
    return rounded(collection.availability_alarm(build(quotes_from_events(spark, sf)).availability).select("collection_date", "availability_rate"), "availability_rate")


@query("health_status", "SELECT collection_date, CASE WHEN date_diff('day', collection_date, DATE '2024-01-30') <= 1 AND availability_rate >= 0.8 THEN 'healthy' WHEN date_diff('day', collection_date, DATE '2024-01-30') <= 2 THEN 'degraded' ELSE 'stale' END AS status FROM availability")
def health_status(spark, sf):
    a = build(quotes_from_events(spark, sf)).availability
    return a.select("collection_date", collection.health_status(F.col("collection_date"), F.col("availability_rate"), F.lit("2024-01-30").cast("date")).alias("status"))


@query(
    "cell_outcomes",
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'robots_disallowed' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'timeout' WHEN event_type = 'error' THEN 'parse_error' WHEN event_type = 'purchase' THEN 'blocked' WHEN value > 20 THEN NULL WHEN event_type = 'view' THEN 'sold_out' ELSE 'parse_error' END AS reason FROM events""",
)
def cell_outcomes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    error = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "Timeout 30000ms exceeded").otherwise("net::ERR"))
    page = F.when(F.col("event_type") == "purchase", "<p>Please solve this CAPTCHA</p>").when(F.col("event_type") == "view", "<p>Sold out</p>").otherwise("<script src=/datadome/perimeterx.js></script><p>hello</p>")
    return e.select("event_id", collection.outcome(F.col("event_id") % 13 != 0, error, page, (F.col("value") > 20).cast("int")).alias("reason"))


@query("robots_decisions", "SELECT event_id, CASE WHEN s IS NULL THEN false WHEN s = 404 THEN true WHEN s >= 400 THEN false ELSE event_type <> 'click' END AS allowed FROM (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END AS s FROM events)")
def robots_decisions(spark, sf):
    k = F.col("event_id") % 4
    status = F.when(k == 0, None).when(k == 1, 404).when(k == 2, 503).otherwise(200)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", collection.robots_decision(status, F.col("event_type") != "click").alias("allowed"))


@query("still_to_collect", "SELECT 's' AS source, r.origin, r.destination, l.lead_time_days FROM routes r CROSS JOIN (SELECT DISTINCT lead_time_days FROM scenarios) l ANTI JOIN (SELECT * FROM quotes WHERE collection_date = DATE '2024-01-02' AND is_available) q ON q.origin = r.origin AND q.destination = r.destination AND q.lead_time_days = l.lead_time_days")
def still_to_collect(spark, sf):
    cells = dimensions.cells(spark, "2024-01-02").select(F.lit("s").alias("source"), *C.STRATUM_KEY)
    return collection.still_to_collect(cells, quotes_from_events(spark, sf).where("collection_date = date '2024-01-02' and is_available"))


@query("cheapest_in_cell", "SELECT quote_id, row_number() OVER (PARTITION BY collection_date, source, origin, destination, lead_time_days ORDER BY total_fare, quote_id) = 1 AS is_cheapest_in_cell FROM quotes WHERE total_fare > 0")
def cheapest_in_cell(spark, sf):
    return collection.cheapest_in_cell(quotes_from_events(spark, sf), ["collection_date", "source", *C.STRATUM_KEY], "quote_id").select("quote_id", "is_cheapest_in_cell")


@query("top_endpoints", "SELECT event_id AS url, CAST(least(user_id, 20) + least(CAST(json_extract_string(props, '$.k') AS INTEGER), 20) * 1.5 + 2 * (event_id % 5) + CASE WHEN value > 50 THEN 3 ELSE 0 END AS DOUBLE) AS score FROM events ORDER BY score DESC, url LIMIT 6")
def top_endpoints(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    s = collection.probe_score(F.col("user_id"), k, F.col("event_id") % 5, F.col("value") * 100)
    return collection.top_endpoints(e.select(F.col("event_id").alias("url"), s.cast("double").alias("score")))


# --- diagnostics and the regression -------------------------------------------------------------------------------


def _series(b):
    return {"chained": aggregate.published(b.headline()).select("collection_date", "index_value"), "geks": b.geks(), "direct": b.direct().select("collection_date", "direct_index")}


_AGREE = "SELECT p.pair, count(*) AS n_days, round(corr(p.dx, p.dy), 6) AS corr_of_log_changes, round(avg(abs(p.x - p.y)), 4) AS mean_abs_level_gap, round(arg_max(p.x - p.y, p.collection_date), 4) AS final_level_gap FROM (SELECT pair, x, y, collection_date, ln(x) - lag(ln(x)) OVER (PARTITION BY pair ORDER BY collection_date) AS dx, ln(y) - lag(ln(y)) OVER (PARTITION BY pair ORDER BY collection_date) AS dy FROM (SELECT 'chained_vs_geks' AS pair, index_value AS x, geks_index AS y, collection_date FROM all_series UNION ALL SELECT 'chained_vs_direct', index_value, direct_index, collection_date FROM all_series UNION ALL SELECT 'geks_vs_direct', geks_index, direct_index, collection_date FROM all_series)) p GROUP BY p.pair"
_ALL = {"all_series": "SELECT * FROM drift_days WHERE direct_index IS NOT NULL"}


@query("series_agreement", _AGREE, _ALL)
def series_agreement(spark, sf):
    b = build(quotes_from_events(spark, sf))
    return rounded(rounded(diagnostics.agreement(_series(b)), "corr_of_log_changes"), "mean_abs_level_gap", "final_level_gap", places=4)


@query("compare_levels", "SELECT count(*) AS n, round(corr(index_value, direct_index), 6) AS pearson_r, round(avg(abs(index_value - direct_index)), 4) AS mean_abs_divergence_pts, round(max(abs(index_value - direct_index)), 4) AS max_abs_divergence_pts FROM published p JOIN direct d ON d.collection_date = p.collection_date WHERE p.scenario = 'uniform' AND direct_index IS NOT NULL")
def compare_levels(spark, sf):
    b = build(quotes_from_events(spark, sf))
    out = diagnostics.compare_levels(aggregate.published(b.headline()), b.direct(), "index_value", "direct_index")
    return rounded(rounded(out, "pearson_r"), "mean_abs_divergence_pts", "max_abs_divergence_pts", places=4)


_MONTHS = {
    "daily": "SELECT CAST(o_orderdate AS DATE) AS collection_date, exp(avg(ln(o_totalprice))) AS index_value FROM orders WHERE o_totalprice > 0 GROUP BY 1",
    "cpi": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_extendedprice) AS cpi_index FROM lineitem GROUP BY 1",
    "months": "SELECT m.month, m.x, c.cpi_index AS y, ln(m.x) - lag(ln(m.x)) OVER (ORDER BY m.month) AS dx, ln(c.cpi_index) - lag(ln(c.cpi_index)) OVER (ORDER BY m.month) AS dy FROM (SELECT CAST(date_trunc('month', collection_date) AS DATE) AS month, avg(index_value) AS x FROM daily GROUP BY 1) m JOIN cpi c ON c.month = m.month",
}


@query("compare_to_monthly", "SELECT count(*) AS overlapping_months, count(dx) AS n_changes, round(corr(dx, dy), 6) AS r, round(avg(CASE WHEN dx IS NOT NULL THEN CASE WHEN sign(dx) = sign(dy) THEN 1.0 ELSE 0.0 END END), 6) AS direction_agreement, CASE WHEN corr(dx, dy) > 0.6 THEN 'strong' WHEN corr(dx, dy) > 0.2 THEN 'moderate' ELSE 'weak' END AS reading FROM months", _MONTHS)
def compare_to_monthly(spark, sf):
    daily = spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice > 0").groupBy(F.to_date("o_orderdate").alias("collection_date")).agg(F.exp(F.avg(F.log("o_totalprice"))).alias("index_value"))
    cpi = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.avg("l_extendedprice").alias("cpi_index"))
    return rounded(diagnostics.compare_to_monthly(daily, cpi), "r", "direction_agreement")


@query("median_by_route", "SELECT origin, destination, quantile_cont(total_fare, 0.5) AS median_fare, count(*) AS n FROM quotes WHERE is_available GROUP BY ALL")
def median_by_route(spark, sf):
    return diagnostics.median_by_route(quotes_from_events(spark, sf))


@query("fare_level_ratio", "SELECT origin, destination, median_fare, n, average_fare, round(median_fare / average_fare, 6) AS ratio, round((SELECT quantile_cont(median_fare / average_fare, 0.5) FROM m), 6) AS median_ratio FROM m", {"m": "SELECT q.origin, q.destination, quantile_cont(total_fare, 0.5) AS median_fare, count(*) AS n, r.route_id + 30.0::DOUBLE AS average_fare FROM quotes q JOIN routes r ON r.origin = q.origin AND r.destination = q.destination WHERE is_available GROUP BY ALL"})
def fare_level_ratio(spark, sf):
    bench = dimensions.routes(spark).select("origin", "destination", (F.col("route_id") + 30.0).alias("average_fare"))
    return rounded(diagnostics.compare_fare_levels(quotes_from_events(spark, sf), bench), "ratio", "median_ratio")


@query("hedonic_design", "SELECT quote_id, route, CAST(dep_dow AS INTEGER) AS dep_dow, CASE WHEN h <= 5 THEN 'red_eye' WHEN h <= 9 THEN 'early_morning' WHEN h <= 12 THEN 'morning' WHEN h <= 17 THEN 'afternoon' WHEN h <= 21 THEN 'evening' ELSE 'night' END AS dep_hour_band, round(ln(total_fare), 6) AS log_fare FROM (SELECT *, origin || '-' || destination AS route, isodow(dep_ts + INTERVAL 330 MINUTE) - 1 AS dep_dow, hour(dep_ts + INTERVAL 330 MINUTE) AS h FROM raw WHERE is_available AND total_fare > 0)", RAW)
def hedonic_design(spark, sf):
    return rounded(hedonic.prepare(_raw(spark, sf)).select("quote_id", "route", "dep_dow", "dep_hour_band", "log_fare"), "log_fare")


@query("regression_weights", "SELECT quote_id, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT q.quote_id, r.weight * 0.2 / count(*) OVER (PARTITION BY q.collection_date, q.origin, q.destination, q.lead_time_days) AS w FROM raw q JOIN routes r ON r.origin = q.origin AND r.destination = q.destination WHERE q.is_available AND q.total_fare > 0)", RAW)
def regression_weights(spark, sf):
    df = hedonic.with_weights(hedonic.prepare(_raw(spark, sf)), dimensions.routes(spark), dimensions.scenario(C.HEADLINE))
    return rounded(df.select("quote_id", F.col("_w").alias("weight")), "weight")


@query("hedonic_index")
def hedonic_index(spark, sf):
    r = hedonic.fit(_raw(spark, sf), dimensions.routes(spark), dimensions.scenario(C.HEADLINE))
    return r.series if r else spark.createDataFrame([], "collection_date date, hedonic_index double, se double, ci_low double, ci_high double")


_TERMS = {"route": "origin || '-' || destination", "carrier": "carrier", "lead_time_days": "CAST(lead_time_days AS VARCHAR)", "dep_dow": "CAST(isodow(dep_ts + INTERVAL 330 MINUTE) - 1 AS VARCHAR)", "dep_hour_band": "CASE WHEN h <= 5 THEN 'red_eye' WHEN h <= 9 THEN 'early_morning' WHEN h <= 12 THEN 'morning' WHEN h <= 17 THEN 'afternoon' WHEN h <= 21 THEN 'evening' ELSE 'night' END", "collection_date": "CAST(collection_date AS VARCHAR)"}


@query("hedonic_normal_equations", "SELECT * FROM (" + " UNION ".join(f"SELECT '{t}' AS term, {c} AS level, 0.0::DOUBLE AS weighted_residuals FROM (SELECT *, hour(dep_ts + INTERVAL 330 MINUTE) AS h FROM raw WHERE is_available AND total_fare > 0)" for t, c in _TERMS.items()) + ") QUALIFY count(*) OVER (PARTITION BY term) > 1", RAW)
def hedonic_normal_equations(spark, sf):
    """What the fit has to fulfil: over the quotes of each level of each term, the weighted residuals add up to nothing."""
    return rounded(hedonic.normal_equations(_raw(spark, sf), dimensions.routes(spark), dimensions.scenario(C.HEADLINE)), "weighted_residuals")


_ONE = {
    "weighted": """SELECT *, hour(dep_ts + INTERVAL 330 MINUTE) AS h, w / avg(w) OVER () AS weight FROM (SELECT q.*, r.weight * s.lead_weight / count(*) OVER (PARTITION BY q.collection_date, q.origin, q.destination, q.lead_time_days) AS w
        FROM raw q JOIN routes r ON r.origin = q.origin AND r.destination = q.destination JOIN scenarios s ON s.scenario = 'near_term_heavy' AND s.lead_time_days = q.lead_time_days WHERE q.is_available AND q.total_fare > 0)"""
}
_ONE["named_levels"] = "SELECT weight, ln(total_fare) AS y, [" + ", ".join(f"{{'k': {k}, 't': '{t}', 'l': {c}}}" for k, (t, c) in enumerate(_TERMS.items())) + "] AS x FROM weighted"
_ONE["several"] = "SELECT a.t AS t FROM (SELECT unnest(x) AS a FROM named_levels) GROUP BY a.t HAVING count(DISTINCT a.l) > 1 OR a.t = 'collection_date'"  # the others are left out of the fit
_SUMS = "count(*) AS n, round(sum(weight), 6) AS weight, round(sum(weight * y), 6) AS weighted_log_fare"


@query(
    "hedonic_gram",
    f"""SELECT NULL AS term_a, NULL AS level_a, NULL AS term_b, NULL AS level_b, {_SUMS} FROM named_levels UNION ALL SELECT a.t, a.l, NULL, NULL, {_SUMS} FROM (SELECT *, unnest(x) AS a FROM named_levels) WHERE a.t IN (SELECT t FROM several) GROUP BY a.t, a.l
    UNION ALL SELECT a.t, a.l, b.t, b.l, {_SUMS} FROM (SELECT *, unnest(x) AS b FROM (SELECT *, unnest(x) AS a FROM named_levels)) WHERE a.k < b.k AND a.t IN (SELECT t FROM several) AND b.t IN (SELECT t FROM several) GROUP BY a.t, a.l, b.t, b.l""",
    RAW | _ONE,
)
def hedonic_gram(spark, sf):
    """The sums that the regression is solved from, under a scenario that weighs lead times differently."""
    return rounded(hedonic.level_pairs(_raw(spark, sf), dimensions.routes(spark), dimensions.scenario("near_term_heavy")), "weight", "weighted_log_fare")


# --- scalar functions and extraction ------------------------------------------------------------------------------


@query(
    "parsed_fares",
    """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE round(value * 100, 0) END AS fare, CASE event_type WHEN 'click' THEN 'IX' WHEN 'view' THEN 'AI' WHEN 'purchase' THEN 'SG' WHEN 'signup' THEN '6E' END AS carrier, CASE event_type WHEN 'click' THEN 'IX' || (100 + user_id % 900) WHEN 'purchase' THEN 'SG' || (100 + user_id % 900) END AS flight_no FROM events""",
)
def parsed_fares(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = F.round(F.col("value") * 100, 0).cast("long")
    k = F.col("event_id") % 5
    shown = F.when(k == 0, F.concat(F.lit("₹"), F.lpad(n.cast("string"), 5, "0"))).when(k == 1, F.concat(F.lit("Rs. "), F.lpad(n.cast("string"), 5, "0"))).when(k == 2, F.format_number(n, 0)).when(k == 3, n.cast("string")).otherwise("n/a")
    no = (100 + F.col("user_id") % 900).cast("string")
    t = F.col("event_type")
    text = F.when(t == "click", F.concat(F.lit("Air India Express IX-"), no)).when(t == "view", "Air India").when(t == "purchase", F.concat(F.lit("SG "), no)).when(t == "signup", "IndiGo").otherwise("some airline")
    return e.select("event_id", fares.parse_inr(shown).cast("double").alias("fare"), fares.detect_carrier(text).alias("carrier"), fares.detect_flight_no(text).alias("flight_no"))


def _dealt_events(spark, sf):
    """The events' few narrow columns, dealt to all tasks: a file may be one split, and the texts made of its rows cost far more to read than this shuffle."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type")
    return e.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")


@query(
    "journey_offers",
    """SELECT event_id AS doc_id, CAST(1000 + event_id % 9000 AS DOUBLE) AS total_fare, '6E' AS carrier, '6E' || (100 + user_id % 900) AS flight_no, CAST(event_id % 3 AS INTEGER) AS stops, '2024-02-03 04:00' AS dep_raw FROM events WHERE event_id % 2 = 0""",
)
def journey_offers(spark, sf):
    """Payloads of the known layout made of events; those of odd ids are for another route and give nothing."""
    e = _dealt_events(spark, sf)
    stops = F.when(F.col("event_id") % 3 == 0, "Non-Stop").otherwise(F.concat((F.col("event_id") % 3).cast("string"), F.lit(" stop")))
    route = F.when(F.col("event_id") % 2 == 0, "DELBOM").otherwise("DELBLR")
    payload = F.format_string('{"CFee": 300, "j": [{"s": [{"SD": "%s|%d|9|DEL-BOM||", "segMatchingKey": "%sSat-03Feb202404:0006:156E %d", "b": [{"stp": "0"}]}]}]}', stops, 1000 + F.col("event_id") % 9000, route, 100 + F.col("user_id") % 900)
    p = e.select(F.col("event_id").alias("doc_id"), payload.alias("payload"), F.lit("DEL").alias("origin"), F.lit("BOM").alias("destination"))
    return offers.journey_offers(p)


@query("json_offers", "SELECT event_id AS doc_id, CAST(1000 + event_id % 9000 AS DOUBLE) AS total_fare, 'SG' AS carrier, 'SG' || (100 + user_id % 900) AS flight_no, CAST(user_id % 3 AS INTEGER) AS stops, CAST(NULL AS VARCHAR) AS dep_raw FROM events WHERE user_id % 7 <> 0")
def json_offers(spark, sf):
    """Flat payloads made of events, with base fares and taxes beside the totals; some without an airline."""
    e = _dealt_events(spark, sf)
    with_airline = F.format_string('{"Results": [{"AirlineCode": "SG", "FlightNumber": "%d", "BaseFare": 1001, "Taxes": 1002, "TotalFare": %d, "Stops": %d}]}', 100 + F.col("user_id") % 900, 1000 + F.col("event_id") % 9000, F.col("user_id") % 3)
    payload = F.when(F.col("user_id") % 7 == 0, '{"Results": [{"TotalFare": 5000}]}').otherwise(F.regexp_replace(with_airline, r'"FlightNumber": "(\d+)"', r'"FlightNumber": "SG-$1"'))
    return offers.json_offers(e.select(F.col("event_id").alias("doc_id"), payload.alias("payload")))


_CITY = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in urls.CITY_NAMES.items()) + " ELSE {c} END"


@query(
    "quotes_from_offers",
    """SELECT quote_id, total_fare, row_number() OVER (PARTITION BY collection_date, source, origin, destination, lead_time_days ORDER BY total_fare, quote_id) = 1 AS is_cheapest_in_cell, dep_date FROM (SELECT quote_id, collection_date, source, origin, destination, lead_time_days, round(total_fare, 2) AS total_fare, CAST(collection_date + CAST(lead_time_days AS INTEGER) AS DATE) AS dep_date FROM quotes) WHERE total_fare > 0""",
)
def quotes_from_offers(spark, sf):
    q = quotes_from_events(spark, sf).drop("is_available", "unavailable_reason")
    return offer_rows.to_quotes(q, "quote_id").select("quote_id", F.col("total_fare").cast("double").alias("total_fare"), "is_cheapest_in_cell", "dep_date")


@query(
    "one_row_a_cell",
    """SELECT q.source, q.origin, q.destination, q.lead_time_days, q.is_available, NULL::VARCHAR AS unavailable_reason, count(*) AS n FROM (SELECT * FROM quotes WHERE is_available AND collection_date = DATE '2024-01-10') q GROUP BY ALL
    UNION ALL SELECT 's', w.origin, w.destination, w.lead_time_days, false, 'parse_error', 1 FROM weights w ANTI JOIN (SELECT * FROM quotes WHERE is_available AND collection_date = DATE '2024-01-10') q ON q.origin = w.origin AND q.destination = w.destination AND q.lead_time_days = w.lead_time_days WHERE w.scenario = 'uniform'""",
)
def one_row_a_cell(spark, sf):
    day = "2024-01-10"
    q = quotes_from_events(spark, sf).where(F.col("is_available") & (F.col("collection_date") == F.lit(day).cast("date")))
    cells = dimensions.cells(spark, day).withColumn("source", F.lit("s"))
    rows = offer_rows.one_row_a_cell(cells, q.withColumn("total_fare", F.col("total_fare").cast("decimal(12,2)")))
    return rows.groupBy("source", *C.STRATUM_KEY, "is_available", "unavailable_reason").agg(F.count("*").alias("n"))


@query("market_signals", "SELECT unavailable_reason, unavailable_reason IN ('sold_out', 'no_service') AS is_market_signal, count(*) AS n FROM quotes WHERE unavailable_reason IS NOT NULL GROUP BY ALL")
def market_signals(spark, sf):
    q = quotes_from_events(spark, sf).where("unavailable_reason is not null")
    return q.groupBy("unavailable_reason", offer_rows.is_market_signal(F.col("unavailable_reason")).alias("is_market_signal")).agg(F.count("*").alias("n"))


@query("health_by_source", "SELECT collection_date, event_type AS source, CAST(count(*) AS INTEGER) AS cells_attempted, CAST(count(*) FILTER (WHERE value > 20) AS INTEGER) AS cells_available FROM (SELECT CAST(ts AS DATE) AS collection_date, event_type, value FROM events) GROUP BY ALL")
def health_by_source(spark, sf):
    """Health entries hold a map of counters by source; one row a source comes out."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    per = e.groupBy(F.to_date("ts").alias("collection_date"), "event_type").agg(F.count("*").cast("int").alias("cells_attempted"), F.count_if(F.col("value") > 20).cast("int").alias("cells_available"))
    entries = per.groupBy("collection_date").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("cells_attempted", "cells_available")))).alias("per_source"))  # a few sources a day
    return collection.explode_health(entries)


@query("mapped_cities", "SELECT City1, City2, origin, destination, count(*) AS n FROM mapped GROUP BY ALL", RAW)
def mapped_cities(spark, sf):
    m = basket.map_cities(basket.trailing(_traffic(spark, sf)), _codes(spark, sf))
    return m.groupBy("City1", "City2", "origin", "destination").agg(F.count("*").alias("n"))


@query("upserted_runs", "SELECT run_id, collection_date, CASE WHEN day_no > 20 THEN 'late' ELSE status END AS status FROM (SELECT r.*, d.day_no FROM runs r JOIN days d ON d.collection_date = r.collection_date)", RAW)
def upserted_runs(spark, sf):
    runs = _runs(spark, sf).select("run_id", "collection_date", "status")
    days = build(quotes_from_events(spark, sf)).days.where("day_no > 20")
    return vintages.upsert_runs(runs, runs.join(days, "collection_date", "left_semi").withColumn("status", F.lit("late")))


@query("weakest_pair", f"SELECT pair, corr_of_log_changes FROM ({_AGREE}) ORDER BY corr_of_log_changes, pair LIMIT 1", _ALL)
def weakest_pair(spark, sf):
    b = build(quotes_from_events(spark, sf))
    return diagnostics.weakest_pair(rounded(diagnostics.agreement(_series(b)), "corr_of_log_changes").select("pair", "corr_of_log_changes"))


_VALUE = "CASE WHEN {0} IS NULL THEN 'n' ELSE length(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_ROW = " || ".join(_VALUE.format(c) for c in ("collection_date", "scenario", "CAST(index_value AS DECIMAL(18, 4))"))


@query("published_hash", f"SELECT sha256(concat_ws(':', CAST(count(*) AS VARCHAR), CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR), CAST(sum(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR))) AS sha256 FROM (SELECT sha256({_ROW}) AS h FROM published)")
def published_hash(spark, sf):
    """One digest of all published values, whatever their order."""
    p = aggregate.published(build(quotes_from_events(spark, sf)).points)
    return sinks.content_hash(p.withColumn("index_value", F.col("index_value").cast("decimal(18,4)")), ["collection_date", "scenario", "index_value"])


_META = {
    "meta_band": QUERY_SQL["scenario_band"], "meta_drift": QUERY_SQL["drift_diagnostic"], "meta_tiers": QUERY_SQL["imputation_summary"],
    "meta_head": "SELECT (SELECT count(*) FROM days) AS collection_days, (SELECT min(collection_date) FROM days) AS first_day, (SELECT max(collection_date) FROM days) AS last_day, 'uniform' AS headline_scenario, max(collection_date) AS latest_day, arg_max(index_value, collection_date) AS latest_value FROM published WHERE scenario = 'uniform'",
    "meta_newest": "SELECT collection_date AS band_day, band_low, band_high, band_width FROM meta_band ORDER BY collection_date DESC LIMIT 1",
    "meta_days": "SELECT string_agg(CAST(collection_date AS VARCHAR) || ' ' || observed || ' ' || imputed_route_movement || ' ' || imputed_leadtime_movement || ' ' || imputed_all_items_movement || ' ' || no_donor, ',' ORDER BY collection_date) AS tiers FROM meta_tiers",
}


@query("index_meta", "SELECT h.*, b.*, CAST(d.n AS BIGINT) AS drift_days, d.final_chained, d.final_geks, d.final_gap_pts, d.gap_trend_pts_per_day, d.reading, t.tiers FROM meta_head h CROSS JOIN meta_newest b CROSS JOIN meta_drift d CROSS JOIN meta_days t", _META)
def index_meta(spark, sf):
    m = sinks.index_meta(build(quotes_from_events(spark, sf)))
    day = F.transform("imputation_by_day", lambda x: F.concat_ws(" ", x.collection_date.cast("string"), *[x[t].cast("string") for t in imputation.TIERS]))
    out = m.select(
        "collection_days", "first_day", "last_day", "headline_scenario", F.col("latest.collection_date").alias("latest_day"), F.col("latest.index_value").alias("latest_value"),
        F.col("band_latest.collection_date").alias("band_day"), *[F.col(f"band_latest.{c}").alias(c) for c in ("band_low", "band_high", "band_width")],
        F.col("chain_drift.n").alias("drift_days"), *[F.col(f"chain_drift.{c}").alias(c) for c in ("final_chained", "final_geks", "final_gap_pts", "gap_trend_pts_per_day", "reading")], F.array_join(day, ",").alias("tiers"),
    )
    return rounded(rounded(out, "final_geks", "final_gap_pts"), "gap_trend_pts_per_day", "band_width", places=4)


# --- pages and probes ---------------------------------------------------------------------------------------------


def _pages(spark, sf):
    """A page for each event: two rows in a list, one with a flight number and one without, beside prices that are no offers."""
    e = _dealt_events(spark, sf)
    fare = F.format_number(1300 + F.col("event_id") % 9000, 0)
    row = F.when(F.col("event_type") == "click", F.concat(F.lit("IndiGo 6E-"), (100 + F.col("user_id") % 900).cast("string"))).when(F.col("event_type") == "view", "Air India Express").otherwise("Mystery Airlines")
    page = F.concat(F.lit("<html><script>var p = '₹7,777 6E-777'</script><ul><li><b>"), row, F.lit("</b> <i>₹"), fare, F.lit("</i></li></ul><p>from ₹299 or ₹4,00,000 for all of you</p></html>"))
    return e.select(F.col("event_id").alias("doc_id"), page.alias("payload"))


@query("page_offers", "SELECT event_id AS doc_id, CAST(1300 + event_id % 9000 AS DOUBLE) AS total_fare, '6E' AS carrier, '6E' || (100 + user_id % 900) AS flight_no, CAST(NULL AS INTEGER) AS stops, CAST(NULL AS VARCHAR) AS dep_raw FROM events WHERE event_type = 'click'")
def page_offers(spark, sf):
    return offers.page_offers(_pages(spark, sf))


@query("page_rows", "SELECT event_id AS doc_id, CAST(1300 + event_id % 9000 AS DOUBLE) AS total_fare, CASE event_type WHEN 'click' THEN '6E' WHEN 'view' THEN 'IX' END AS carrier, CAST(NULL AS VARCHAR) AS flight_no, CAST(NULL AS INTEGER) AS stops, CAST(NULL AS VARCHAR) AS dep_raw FROM events")
def page_rows(spark, sf):
    return offers.page_rows(_pages(spark, sf))


def _probes(spark, sf):
    e = _dealt_events(spark, sf)
    payload = F.format_string('{"a": {"n": %d, "flag": true}, "list": [{"first": %d}, {"second": %d}], "text": "5000"}', F.col("event_id") % 3000, F.col("user_id") + 1000, F.col("user_id") + 90_000)
    return e.select(F.col("event_id").alias("doc_id"), payload.alias("payload"))


@query("probe_numbers", "SELECT event_id AS doc_id, n AS number FROM (SELECT event_id, unnest([CAST(event_id % 3000 AS DOUBLE), user_id + 1000.0, user_id + 90000.0]) AS n FROM events) WHERE n BETWEEN 1200 AND 90000")
def probe_numbers(spark, sf):
    return offers.numbers(_probes(spark, sf)).select("doc_id", "number")


@query("probe_keys", "SELECT event_id AS doc_id, unnest(['a', 'n', 'flag', 'list', 'first', 'text']) AS key FROM events")
def probe_keys(spark, sf):
    return offers.top_keys(_probes(spark, sf))


@query("probe_verdicts", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'bot_wall' WHEN event_type = 'error' THEN 'error' WHEN event_id % 3 > 0 AND user_id % 2 > 0 THEN 'json_endpoint_found' WHEN event_id % 3 > 0 THEN 'json_seen_no_fares' ELSE 'no_json_fare_endpoint' END AS verdict FROM events")
def probe_verdicts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", collection.probe_verdict(F.col("event_id") % 13 == 0, F.col("event_type") == "error", F.col("event_id") % 3, F.col("user_id") % 2).alias("verdict"))


@query("strata_seen", "SELECT DISTINCT d.collection_date, n.origin, n.destination, n.lead_time_days FROM days d JOIN numbered n ON n.day_no IN (d.day_no, d.day_no - 1) WHERE d.day_no > 1")
def strata_seen(spark, sf):
    b = build(quotes_from_events(spark, sf))
    return elementary.strata_seen(b.items, b.days)


@query("payloads_unread", "SELECT event_id AS doc_id, CASE WHEN event_type = 'error' THEN 'no JSON' ELSE 'nested beyond the parser''s depth' END AS reason FROM events WHERE event_type = 'error' OR event_id % 1009 = 0")
def payloads_unread(spark, sf):
    """Payloads cut short, and some nested very deep, among readable ones."""
    p = _probes(spark, sf).join(spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("doc_id"), "event_type"), "doc_id")
    deep = F.concat(F.repeat(F.lit("["), 100_000), F.repeat(F.lit("]"), 100_000))
    payload = F.when(F.col("event_type") == "error", F.expr("left(payload, length(payload) - 3)")).when(F.col("doc_id") % 1009 == 0, deep).otherwise(F.col("payload"))
    return offers.unreadable(p.select("doc_id", payload.alias("payload")))
