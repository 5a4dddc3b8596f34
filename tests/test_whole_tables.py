"""Queries read their whole input: every row counts, whatever its ids."""

import datetime

import pytest
from pyspark.sql import functions as F

from indexloom.plans import catalogue
from indexloom.sources import offers

QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Six events of two points, of users 1 to 6; only user 5 is a multiple of five."""
    at = lambda day, hour: datetime.datetime(2024, 1, day, hour)
    rows = [(1, at(1, 1), 1, "view", 10.0), (2, at(1, 2), 2, "view", 12.0), (3, at(1, 14), 3, "view", 12.0), (4, at(1, 15), 4, "view", 11.0), (5, at(2, 3), 5, "click", 20.0), (6, at(2, 13), 6, "click", 21.5)]
    sf = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(f"{sf}/events.parquet")
    return sf


def test_vintage_queries_read_all_users(spark, small):
    run = lambda name: QUERIES[name](spark, small).collect()
    assert sorted((r.scenario, r.index_value) for r in run("index_latest")) == [("click", 21.5), ("view", 11.0)]
    assert sorted((r.scenario, r.vintage_no, r.vintages) for r in run("index_vintages")) == [("click", 1, 2), ("click", 2, 2)] + [("view", i, 4) for i in range(1, 5)]
    assert sorted((r.scenario, r.from_vintage, r.revision_points) for r in run("index_revisions")) == [("click", 1, 1.5), ("view", 1, 2.0), ("view", 3, -1.0)]
    assert sorted(r.index_value for r in run("append_vintage")) == [10.0, 11.0, 12.0, 12.0, 20.0, 21.5]


def test_journey_offers_passes_on_all_that_the_operator_finds(spark, small, monkeypatch):
    monkeypatch.setattr(offers, "journey_offers", lambda p: p.select("doc_id", F.lit(1.0).alias("total_fare")))
    assert sorted(r.doc_id for r in QUERIES["journey_offers"](spark, small).collect()) == [1, 2, 3, 4, 5, 6]
