"""Reads and writes over JDBC, against the embedded database that Spark brings along.

Spark sends a null text to it as a type that it refuses, so texts here aren't null; other columns are.
"""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from indexloom.sources import databases as db

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
TABLES = [
    "CREATE TABLE collection_runs (run_id VARCHAR(40) NOT NULL PRIMARY KEY, collection_date DATE, status VARCHAR(20), cells_available INTEGER)",
    "CREATE TABLE raw_quotes (quote_id BIGINT, collection_date DATE, collection_ts_utc TIMESTAMP, source VARCHAR(20), origin CHAR(3), destination CHAR(3), lead_time_days INTEGER, dep_date DATE, dep_ts TIMESTAMP, carrier VARCHAR(10), total_fare DECIMAL(12,2), currency CHAR(3), is_available BOOLEAN, unavailable_reason VARCHAR(20))",
    "CREATE TABLE source_health (run_id VARCHAR(40) NOT NULL, source VARCHAR(20) NOT NULL, cells_available INTEGER, PRIMARY KEY (run_id, source))",
    "CREATE TABLE robots_log (run_id VARCHAR(40), path VARCHAR(200), allowed BOOLEAN)",
    "CREATE TABLE index_values (collection_date DATE NOT NULL, scenario VARCHAR(30) NOT NULL, series VARCHAR(30) NOT NULL, computed_at_utc TIMESTAMP NOT NULL, index_value DOUBLE, PRIMARY KEY (collection_date, scenario, series, computed_at_utc))",
]


@pytest.fixture
def url(spark, request):
    u = f"jdbc:derby:memory:{request.node.name.replace('[', '_').replace(']', '')};create=true"
    with db.connected(spark, u, **DRIVER) as con:
        for sql in TABLES:
            db.execute(con, sql)
    return u


def stored(spark, url, table):
    return [tuple(r) for r in spark.read.format("jdbc").options(url=url, dbtable=table, **DRIVER).load().collect()]


def runs(spark, *rows):
    return spark.createDataFrame([(r, date(2026, 9, 1), s, n) for r, s, n in rows], "run_id string, collection_date date, status string, cells_available int")


def quotes(spark, n=40):
    q = spark.range(n).select(F.col("id").alias("quote_id"), F.date_add(F.lit("2026-09-01").cast("date"), (F.col("id") % 3).cast("int")).alias("collection_date"))
    return q.select("*", F.lit(datetime(2026, 9, 1, 3)).alias("collection_ts_utc"), F.lit("s").alias("source"), F.lit("DEL").alias("origin"), F.lit("BOM").alias("destination"), F.lit(7).alias("lead_time_days"), F.col("collection_date").alias("dep_date"), F.lit(None).cast("timestamp").alias("dep_ts"), F.lit("6E").alias("carrier"), (F.col("quote_id") * 10 + 1000).cast("decimal(12,2)").alias("total_fare"), F.lit("INR").alias("currency"), F.lit(True).alias("is_available"), F.lit("").alias("unavailable_reason"))


def rest(spark):
    health = spark.createDataFrame([("r1", "a", 5), ("r1", "b", 6)], "run_id string, source string, cells_available int")
    robots = spark.createDataFrame([("r1", "/x", True), ("r1", "/x", True), ("r1", "", False)], "run_id string, path string, allowed boolean")
    return health, robots


def test_a_collection_is_written_once(spark, url):
    health, robots = rest(spark)
    for name in ("day1", "day1"):
        done = db.write_collection(spark, url, name, runs(spark, ("r1", "ok", 100)), quotes(spark), health, robots, **DRIVER)
    assert done is False  # the second time
    assert len(stored(spark, url, "raw_quotes")) == 40 and len(stored(spark, url, "source_health")) == 2
    assert sorted(map(str, stored(spark, url, "robots_log"))) == ["('r1', '', False)", "('r1', '/x', True)", "('r1', '/x', True)"]
    assert db.write_collection(spark, url, "day1b", runs(spark, ("r1", "late", 110)), quotes(spark).limit(0), health.withColumn("cells_available", F.lit(9)), robots.limit(0), **DRIVER)
    assert [r[2:] for r in stored(spark, url, "collection_runs")] == [("late", 110)]  # replaced
    assert sorted(r[2] for r in stored(spark, url, "source_health")) == [5, 6]  # kept


def test_rows_staged_twice_count_once(spark, url, monkeypatch):
    """A task that is tried again after its rows were committed leaves them twice."""
    twice = db._staged
    monkeypatch.setattr(db, "_staged", lambda into: twice(into).unionByName(twice(into)))
    health, robots = rest(spark)
    assert db.write_collection(spark, url, "day1", runs(spark, ("r1", "ok", 1), ("r2", "ok", 2)), quotes(spark), health, robots, **DRIVER)
    assert len(stored(spark, url, "raw_quotes")) == 40 and len(stored(spark, url, "robots_log")) == 3 and len(stored(spark, url, "collection_runs")) == 2


@pytest.mark.parametrize("at", ["staging", "merging"])
def test_a_killed_write_leaves_nothing_and_can_be_repeated(spark, url, monkeypatch, at):
    health, robots = rest(spark)
    parts = [db.Into(runs(spark, ("r1", "ok", 1), ("r1", "later", 2)), "collection_runs", ("run_id",), replace=True, latest="cells_available"), db.Into(robots, "robots_log")]

    class Killed(BaseException):
        pass

    real, calls = (db._staged if at == "staging" else db.execute), []

    def stop(*args):
        calls.append(args)
        if at == "staging" and len(calls) == 2 or at == "merging" and args[1].startswith("INSERT INTO robots_log"):
            raise Killed
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(db, "_staged" if at == "staging" else "execute", stop)
        with pytest.raises(Killed):
            db.write(spark, url, "w", parts, **DRIVER)
    assert stored(spark, url, "collection_runs") == [] == stored(spark, url, "robots_log")
    assert db.write(spark, url, "w", parts, **DRIVER) and not db.write(spark, url, "w", parts, **DRIVER)
    assert [r[2:] for r in stored(spark, url, "collection_runs")] == [("later", 2)] and len(stored(spark, url, "robots_log")) == 3
    with db.connected(spark, url, **DRIVER) as con:
        assert not db.has_table(con, "stage_w_0") and db.has_table(con, "applied_writes")


def test_what_cannot_be_written_changes_nothing(spark, url):
    health, robots = rest(spark)
    assert not db.write_collection(spark, url, "bad", runs(spark, ("r1", "ok", 1)), quotes(spark), health.withColumn("source", F.repeat(F.lit("x"), 500)), robots, **DRIVER)
    assert stored(spark, url, "raw_quotes") == [] == stored(spark, url, "collection_runs")
    with pytest.raises(ValueError):
        db.write(spark, url, "x; drop", [], **DRIVER)


def test_vintages_keep_what_is_stored(spark, url):
    values = lambda v, at: spark.createDataFrame([(date(2026, 9, d), "uniform", "headline", at, v + d) for d in (1, 2)], "collection_date date, scenario string, series string, computed_at_utc timestamp, index_value double")
    first, second = datetime(2026, 9, 3, 1), datetime(2026, 9, 3, 2)
    assert db.write_vintage(spark, url, "a", values(100.0, first), **DRIVER) and db.write_vintage(spark, url, "b", values(200.0, first), **DRIVER) and db.write_vintage(spark, url, "c", values(300.0, second), **DRIVER)
    assert sorted(r[4] for r in stored(spark, url, "index_values")) == [101.0, 102.0, 301.0, 302.0]


def test_partitioned_read_with_pushed_filters(spark, url):
    db.write(spark, url, "q", [db.Into(quotes(spark), "raw_quotes")], **DRIVER)
    df = db.read_quotes(spark, url, parts=4, **DRIVER)
    assert df.rdd.getNumPartitions() == 4 and df.columns == db.QUOTE_COLUMNS
    assert max(len(p) for p in df.rdd.glom().collect()) <= 12
    some = df.where("collection_date >= date '2026-09-02'").select("quote_id", "total_fare")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(COLLECTION_DATE)" in plan.replace("collection_date", "COLLECTION_DATE") and "carrier" not in plan.lower().split("scan")[1]
    assert some.count() == 26 and df.select("currency").distinct().collect()[0][0] == "INR"
    assert db.read_table(spark, url, "raw_quotes", ["source"], "collection_date", 2, **DRIVER).count() == 40
    assert db.read_table(spark, url, "robots_log", ["path"], None, **DRIVER).count() == 0
    empty = db.read_table(spark, url, "index_values", ["index_value"], "collection_date", **DRIVER)
    assert empty.count() == 0
