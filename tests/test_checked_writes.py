"""Contracts measured on the rows being written: one pass, published only if they hold."""

import pytest
from pyspark.sql import functions as F

from indexloom.operators import contracts
from indexloom.plans.index_build import build, checked_quotes

COLUMNS = "collection_date date, source string, origin string, destination string, lead_time_days int, dep_date date, carrier string, total_fare double, is_available boolean, unavailable_reason string, currency string"


def good(spark, days=3):
    q = spark.range(days * 4).select(F.date_add(F.lit("2026-09-01").cast("date"), (F.col("id") % days).cast("int")).alias("collection_date"), F.lit("ixigo").alias("source"), F.lit("DEL").alias("origin"), F.lit("BOM").alias("destination"), F.lit(7).alias("lead_time_days"))
    return q.withColumn("dep_date", F.date_add("collection_date", 7)).select("*", F.lit("6E").alias("carrier"), F.lit(5432.0).alias("total_fare"), F.lit(True).alias("is_available"), F.lit(None).cast("string").alias("unavailable_reason"), F.lit("INR").alias("currency"))


def test_good_rows_are_published_and_read_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    q = good(spark).mapInArrow(seen, COLUMNS)
    b = build(q, checked=True, folder=str(tmp_path / "quotes"))
    assert b.points.count() == 9 and b.direct().count() == 3 and read.value == 12
    assert spark.read.parquet(str(tmp_path / "quotes")).count() == 12 and not (tmp_path / "quotes.staged").exists()
    with pytest.raises(FileExistsError):
        checked_quotes(good(spark), str(tmp_path / "quotes"))


@pytest.mark.parametrize(
    "change, says",
    [
        ({"total_fare": "1.0D"}, r"available_is_priced \(12\)"), ({"currency": "'USD'", "origin": "'del'"}, r"currency \(12\), origin \(12\)"), ({"source": "'SIMULATED_a'"}, "simulated"), ({"is_simulated": "'yes'"}, "simulated"),
        ({"collection_date": "date '2026-09-01'", "dep_date": "date '2026-09-08'"}, "two collection dates"),
    ],
)
def test_bad_rows_leave_nothing(spark, tmp_path, change, says):
    with pytest.raises(ValueError, match=says):
        checked_quotes(good(spark).withColumns({c: F.expr(v) for c, v in change.items()}), str(tmp_path / "quotes"))
    assert list(tmp_path.iterdir()) == []


def test_empty_tables_have_no_two_dates(spark, tmp_path):
    with pytest.raises(ValueError, match="two"):
        checked_quotes(good(spark).limit(0), str(tmp_path / "q"))
    df = contracts.write_checked(spark.createDataFrame([], "a int"), str(tmp_path / "e"), {"a": F.col("a") > 0})
    assert df.count() == 0
