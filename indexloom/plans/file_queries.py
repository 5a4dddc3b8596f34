"""Queries through files: tables written as CSV in more than one order of columns, and read back by their headers."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.functions import dimensions, urls
from indexloom.operators import aggregate, basket, elementary
from indexloom.plans.incremental import IncrementalIndex
from indexloom.plans.index_build import build
from indexloom.plans.index_queries import QUERY_SQL, query, rounded
from indexloom.plans.mart_queries import _CITY, _VALUE, RAW, SEEDS, THIN, _directed, _raw, _traffic
from indexloom.sources import benchmarks, frozen, quotes, serving, sinks, store
from indexloom.sources.quotes import quotes_from_events
from indexloom.streaming import ingest


def _two_orders(df: DataFrame, odd, folder: str) -> str:
    """Writes df as CSV: rows where `odd` is zero in its order of columns, the others in the opposite one with a further column."""
    names = df.columns
    df.where(odd == 0).write.option("header", True).csv(f"{folder}/one")
    df.where(odd != 0).withColumn("remark", F.lit("x, y")).select("remark", *names[::-1]).write.option("header", True).csv(f"{folder}/two")
    return folder


@query("traffic_read", "SELECT City1, City2, PaxToCity2, PaxFromCity2, CAST(Year AS INTEGER) AS Year, CAST(Month AS INTEGER) AS Month, CAST(Year * 100 + Month AS INTEGER) AS ym FROM traffic", RAW)
def traffic_read(spark, sf):
    return benchmarks.read_traffic(spark, _two_orders(_traffic(spark, sf), F.col("Month") % 2, store.shared(spark, "traffic")))


_SHARES = {"shares": "SELECT origin, destination, CAST(count(*) AS DOUBLE) AS pax, count(*) / sum(count(*)) OVER () AS weight FROM quotes GROUP BY origin, destination"}


def _weights_file(spark: SparkSession, sf: str) -> str:
    """A file of route weights by their numbers of quotes, in an order of its own and without pairs."""
    folder = store.shared(spark, "weights")
    counted = quotes_from_events(spark, sf).groupBy("destination", "origin").agg(F.count("*").cast("double").alias("pax")).cache()
    total = counted.agg(F.sum("pax")).first()[0]
    counted.select((F.col("pax") / total).alias("weight"), "destination", "pax", "origin").coalesce(1).write.option("header", True).csv(folder)
    counted.unpersist()
    return folder


@query("weights_read", "SELECT origin, destination, CAST(NULL AS VARCHAR) AS pair, pax, round(weight, 9) AS weight FROM shares", _SHARES)
def weights_read(spark, sf):
    return rounded(quotes.read_weights(spark, _weights_file(spark, sf)), "weight", places=9)


@query("basket_weights", "SELECT scenario, origin, destination, lead_time_days, round(weight * lead_weight, 9) AS weight FROM shares CROSS JOIN scenarios", _SHARES)
def basket_weights(spark, sf):
    weights = dimensions.basket_weights(quotes.read_weights(spark, _weights_file(spark, sf)), dimensions.scenarios(spark))
    dimensions.check_basket(weights)
    return rounded(weights, "weight", places=9)


_RECORD = "collection_date, source, origin, destination, lead_time_days, carrier, flight_no, total_fare, is_available, unavailable_reason, dep_date"
_RAW_FILES = f"SELECT {_RECORD.replace('dep_date', 'CAST(dep_date AS VARCHAR) AS dep_date')} FROM raw"


def _quote_files(spark: SparkSession, sf: str) -> str:
    return _two_orders(sinks.as_row(_raw(spark, sf)), F.day(F.col("collection_date").cast("date")) % 2, store.shared(spark, "quotes"))


@query("quotes_read", _RAW_FILES, RAW)
def quotes_read(spark, sf):
    return quotes.normalise(quotes.read_csv(spark, _quote_files(spark, sf))).selectExpr(*_RECORD.split(", "))


@query("quotes_landed", _RAW_FILES, RAW)
def quotes_landed(spark, sf):
    """The same files as a stream."""
    landed = store.shared(spark, "landed")
    ingest.run(ingest.quote_files(spark, _quote_files(spark, sf)), landed, store.shared(spark, "progress")).awaitTermination()
    return spark.read.parquet(landed).selectExpr(*_RECORD.split(", "))


@query("stored_read", "SELECT collection_date, scenario, index_value, availability_rate FROM published")
def stored_read(spark, sf):
    """Published points, stored with all their columns and in another order, read by name."""
    folder = store.shared(spark, "outputs")
    points = aggregate.published(build(quotes_from_events(spark, sf)).points)
    sinks.write_outputs({"near": points.where("scenario <> 'uniform'"), "headline": points.where("scenario = 'uniform'").select(*points.columns[::-1])}, folder, "1")
    return sinks.read_stored(spark, folder, "collection_date date, scenario string, index_value double, availability_rate double").rows


_CELLS = {"cells_by_day": "SELECT d.collection_date, r.origin, r.destination, l.lead_time_days, CAST(d.collection_date + CAST(l.lead_time_days AS INTEGER) AS DATE) AS dep_date FROM days d CROSS JOIN routes r CROSS JOIN (SELECT DISTINCT lead_time_days FROM scenarios) l"}


@query("basket_cells", "SELECT *, origin || '->' || destination || '/T+' || lead_time_days AS cell FROM cells_by_day", _CELLS)
def basket_cells(spark, sf):
    return dimensions.cells_on(elementary.calendar(quotes_from_events(spark, sf)).select("collection_date"))


_EMT = f"'https://flight.easemytrip.com/FlightList/Index?srch=' || origin || '-' || {_CITY.format(c='origin')} || '-India|' || destination || '-' || {_CITY.format(c='destination')} || '-India|' || strftime(dep_date, '%d/%m/%Y') || '&px=1-0-0&cbn=0&ar=undefined&isow=true&isdm=true&lang=en-us&IsDoubleSeat=false&CCODE=IN&curr=INR'"
_CT = "'https://www.cleartrip.com/flights/results?adults=1&childs=0&infants=0&class=Economy&depart_date=' || strftime(dep_date, '%d/%m/%Y') || '&from=' || origin || '&to=' || destination || '&intl=n'"


@query("search_urls", f"SELECT collection_date, origin, destination, lead_time_days, 'easemytrip' AS source, {_EMT} AS url, false AS is_fare_endpoint FROM cells_by_day UNION ALL SELECT collection_date, origin, destination, lead_time_days, 'cleartrip', {_CT}, true FROM cells_by_day", _CELLS)
def search_urls(spark, sf):
    """The address of every cell of every day at both sources that have a template."""
    cells = dimensions.cells_on(elementary.calendar(quotes_from_events(spark, sf)).select("collection_date")).withColumn("source", F.explode(F.array(F.lit("easemytrip"), F.lit("cleartrip"))))
    url = urls.search_url(F.col("source"), F.col("origin"), F.col("destination"), F.col("dep_date"))
    return cells.select("collection_date", *C.STRATUM_KEY, "source", url.alias("url")).withColumn("is_fare_endpoint", urls.is_fare_endpoint(F.col("source"), F.col("url")))


_LATE = ("2024-01-09", "2024-01-20", "2024-01-28")


def _late_index(spark: SparkSession, sf: str) -> IncrementalIndex:
    """An index that first misses one day, half of another and a part of a third, and then gets them."""
    q = quotes_from_events(spark, sf)
    index = IncrementalIndex(spark, store.shared(spark, "index"))
    missing = (F.col("collection_date") == F.lit(_LATE[0])) | F.col("collection_date").isin(*_LATE[1:]) & (F.col("quote_id") % 2 == 0)
    index.update(q.where(~missing))
    index.update(q, [datetime.date.fromisoformat(d) for d in _LATE[1:]])
    index.update(q, [datetime.date.fromisoformat(_LATE[0])])
    return index


@query("late_levels", QUERY_SQL["stratum_levels"])
def late_levels(spark, sf):
    return rounded(_late_index(spark, sf).levels(), "stratum_index", places=2)


@query("late_geks", QUERY_SQL["geks_index"])
def late_geks(spark, sf):
    return rounded(_late_index(spark, sf).geks(), "geks_index")


_LEAVES = {
    "frozen_routes": "SELECT origin, destination, pair, CAST(pax AS DECIMAL(20, 2)) AS pax, CAST(pax / sum(pax) OVER () AS DECIMAL(10, 8)) AS weight FROM in_basket",
    "leaf": f"SELECT origin, destination, sha256({' || '.join(_VALUE.format(c) for c in ('origin', 'destination', 'pair', 'pax', 'weight'))}) AS sha256 FROM frozen_routes",
    "branch": "SELECT origin, sha256(string_agg(length(destination) || ':' || destination || sha256, '' ORDER BY destination)) AS sha256 FROM leaf GROUP BY origin",
    "top": "SELECT sha256(string_agg(length(origin) || ':' || origin || sha256, '' ORDER BY origin)) AS basket_sha256 FROM branch",
}


@query("frozen_basket", "SELECT kind, l.origin, l.destination, l.sha256, t.basket_sha256 FROM leaf l CROSS JOIN top t CROSS JOIN (VALUES ('csv'), ('json'), ('yaml')) v(kind)", RAW | _LEAVES)
def frozen_basket(spark, sf):
    """The basket frozen in three kinds of files and read back: every route's hash, and the root that each file holds."""
    folder = store.shared(spark, "basket")
    d = _directed(spark, sf)
    frozen.freeze(basket.basket_routes(d, basket.select_pairs(basket.pair_volume(d), SEEDS, THIN)), folder, 1)
    out = None
    for kind in ("csv", "json", "yaml"):
        rows = frozen.read_frozen(spark, folder, kind)
        frozen.check_frozen(rows)
        part = frozen.leaves(rows).join(rows.select("origin", "destination", "basket_sha256"), ["origin", "destination"]).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


_FIRST, _LAST = datetime.date(2024, 1, 10), datetime.date(2024, 1, 20)


@query("served_points", QUERY_SQL["points_in_range"])
def served_points(spark, sf):
    """Published points of all scenarios stored by scenario and month; a range of one scenario opens its own folders only."""
    folder = store.shared(spark, "points")
    serving.store_series(aggregate.published(build(quotes_from_events(spark, sf)).points), folder, ["scenario"])
    return serving.read_series(spark, folder, "collection_date date, index_value double, scenario string", _FIRST, _LAST, scenario="uniform").select("collection_date", "index_value")


@query("served_levels", "SELECT origin, destination, lead_time_days, collection_date, round(stratum_index, 2) AS stratum_index FROM levels WHERE lead_time_days = 7 AND collection_date >= DATE '2024-01-10'")
def served_levels(spark, sf):
    """Chained levels of all strata stored by lead time and month, one lead time read from a day on."""
    folder = store.shared(spark, "levels")
    serving.store_series(build(quotes_from_events(spark, sf)).levels, folder, ["lead_time_days"])
    schema = "origin string, destination string, collection_date date, stratum_index double, lead_time_days int"
    return rounded(serving.read_series(spark, folder, schema, _FIRST, lead_time_days=7).select(*C.STRATUM_KEY, "collection_date", "stratum_index"), "stratum_index", places=2)
