"""Late days give what a full rebuild gives, and older items aren't read for them."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.plans.incremental import IncrementalIndex
from indexloom.plans.index_build import build

DAYS = [date(2026, 9, 1) + timedelta(days=k) for k in range(12)]
WINDOW = 4


@pytest.fixture(scope="module")
def quotes(spark):
    dice, rows = random.Random(4), []
    strata = [(o, d, lead) for o, d, _ in C.ROUTES[:3] for lead in (1, 7)]
    for k, day in enumerate(DAYS):
        for n, (o, d, lead) in enumerate(strata):
            if n == 5 and k < 7:  # a stratum that is first seen on the eighth day
                continue
            for carrier in ("6E", "AI", "SG"):
                if dice.random() < 0.75 and k != 5:
                    rows.append((day, "s", o, d, lead, carrier, 4000 * dice.uniform(0.7, 1.4), True))
            rows.append((day, "s", o, d, lead, "UK", None, False))
    return spark.createDataFrame(rows, "collection_date date, source string, origin string, destination string, lead_time_days int, carrier string, total_fare double, is_available boolean").withColumn("unavailable_reason", F.lit(None).cast("string")).persist()


def same(index, quotes):
    whole = build(quotes)
    shown = lambda df, v: {tuple(r)[:-1]: -1.0 if r[-1] is None else r[-1] for r in df.select(*[c for c in df.columns if c != v], v).collect()}
    for mine, full, value in ((index.levels(), whole.levels, "stratum_index"), (index.geks(), whole.geks(WINDOW), "geks_index")):
        assert shown(mine, value) == pytest.approx(shown(full, value), rel=1e-9)


@pytest.mark.parametrize("late", [[11], [10, 8], [0], [5], [7]])
def test_a_late_day(spark, quotes, tmp_path, late):
    index = IncrementalIndex(spark, str(tmp_path), WINDOW)
    days = [DAYS[k] for k in late]
    index.update(quotes.where(~F.col("collection_date").isin(days)))
    index.update(quotes, days)
    same(index, quotes)


def test_corrections_removals_and_repeats(spark, quotes, tmp_path):
    index = IncrementalIndex(spark, str(tmp_path), WINDOW)
    index.update(quotes)
    same(index, quotes)
    changed = quotes.withColumn("total_fare", F.when(F.col("collection_date") == F.lit(DAYS[9]), F.col("total_fare") * 1.5).otherwise(F.col("total_fare")))
    for _ in range(2):
        index.update(changed, [DAYS[9]])
        same(index, changed)
    fewer = changed.where(~F.col("collection_date").isin(DAYS[6], DAYS[11]))
    index.update(fewer, [DAYS[6], DAYS[11]])
    same(index, fewer)


def test_only_later_items_are_read(spark, quotes, tmp_path):
    """Days before the last window may be lost without harm to a late day behind them."""
    index = IncrementalIndex(spark, str(tmp_path), WINDOW)
    index.update(quotes.where(F.col("collection_date") != F.lit(DAYS[10])))
    plan = index.items(DAYS[9])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection_date" in plan
    for day in DAYS[:7]:
        for file in (tmp_path / "items" / f"collection_date={day}").glob("*.parquet"):
            file.write_bytes(b"not to be read")
    index.update(quotes, [DAYS[10]])
    same(index, quotes)
