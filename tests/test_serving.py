"""Series stored by scenario and month: what a range of dates reads, and that nothing is lost."""

import datetime

import pytest
from pyspark.sql import functions as F

from indexloom.sources import serving

DAY = datetime.date
SCHEMA = "collection_date date, scenario string, value double"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Two years of days; one scenario holds half of the rows."""
    days = spark.range(730).select(F.date_add(F.lit(DAY(2024, 1, 1)), F.col("id").cast("int")).alias("collection_date"), "id")
    rows = days.withColumn("scenario", F.explode(F.array(*map(F.lit, ["uniform", "uniform", "near", "far"])))).select("collection_date", "scenario", F.col("id").cast("double").alias("value"))
    odd = spark.createDataFrame([(DAY(2024, 3, 3), None, 1.0), (None, "near", 2.0)], SCHEMA)
    folder = "file://" + str(tmp_path_factory.mktemp("series") / "points")
    rows = rows.unionByName(odd)
    serving.store_series(rows, folder, ["scenario"])
    return rows, folder


def same(a, b):
    return sorted(map(tuple, a.select(*b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def files_read(df):
    df.collect()
    (scan,) = leaves(df._jdf.queryExecution().executedPlan())
    return scan.metrics().apply("numFiles").value()


def leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


def test_all_rows_come_back(spark, stored):
    rows, folder = stored
    assert same(serving.read_series(spark, folder, SCHEMA), rows)


def test_a_range_reads_its_months_only(spark, stored):
    rows, folder = stored
    got = serving.read_series(spark, folder, SCHEMA, DAY(2024, 2, 20), DAY(2024, 3, 5), scenario="uniform")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scenario" in plan and "GreaterThanOrEqual(collection_date,2024-02-20)" in plan
    everything = serving.read_series(spark, folder, SCHEMA)
    assert 2 <= files_read(got) <= 4 and files_read(everything) >= 24 * 3
    assert same(got, rows.where("scenario = 'uniform' and collection_date between '2024-02-20' and '2024-03-05'"))


@pytest.mark.parametrize("first, last, where", [(DAY(2025, 12, 1), None, "collection_date >= '2025-12-01'"), (None, DAY(2024, 1, 3), "collection_date <= '2024-01-03'"), (DAY(2030, 1, 1), None, "false")])
def test_open_ranges(spark, stored, first, last, where):
    rows, folder = stored
    assert same(serving.read_series(spark, folder, SCHEMA, first, last), rows.where(where))


def test_null_names_and_no_overwriting(spark, stored, tmp_path):
    rows, folder = stored
    assert [r.value for r in serving.read_series(spark, folder, SCHEMA, scenario=None).collect()] == [1.0]
    with pytest.raises(Exception, match="(?i)exists"):
        serving.store_series(rows, folder, ["scenario"])
    with pytest.raises(ValueError, match="series_month"):
        serving.store_series(rows.withColumn("series_month", F.lit(1)), folder, ["scenario"])
    empty = str(tmp_path / "empty")
    serving.store_series(rows.where("false"), empty, ["scenario"])
    assert serving.read_series(spark, empty, SCHEMA).count() == 0


def test_one_large_day_is_divided(spark, tmp_path):
    """A single series on a single day goes to several tasks, and to files of bounded size."""
    rows = spark.range(4000).select(F.lit(DAY(2024, 1, 1)).alias("collection_date"), F.lit("uniform").alias("scenario"), F.col("id").cast("double").alias("value"))
    folder = str(tmp_path / "large")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        serving.store_series(rows, folder, ["scenario"], rows_a_file=700)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 6 and max(r["count"] for r in files) <= 700
    assert same(serving.read_series(spark, folder, SCHEMA), rows)
