"""The index engine on a worked example and on properties that any such index has."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.functions import dimensions
from indexloom.operators import aggregate, chain, elementary, imputation, multilateral
from indexloom.plans.index_build import build, check_buildable

SCHEMA = "collection_date date, source string, origin string, destination string, lead_time_days int, carrier string, total_fare double, is_available boolean, unavailable_reason string"


def quotes(spark, rows):
    return spark.createDataFrame([(date.fromisoformat(d), "probe", "DEL", dest, 7, car, fare, ok, None if ok else "sold_out") for d, dest, car, fare, ok in rows], SCHEMA)


EXAMPLE = [
    ("2026-09-01", "BOM", "6E", 4000.0, True), ("2026-09-01", "BOM", "AI", 8000.0, True), ("2026-09-01", "BLR", "6E", 3000.0, True), ("2026-09-01", "BLR", "AI", 6000.0, True),
    ("2026-09-02", "BOM", "6E", 5000.0, True), ("2026-09-02", "BOM", "AI", 8000.0, True), ("2026-09-02", "BLR", "6E", 3300.0, True), ("2026-09-02", "BLR", "AI", 5400.0, True),
    ("2026-09-03", "BOM", "6E", 5500.0, True), ("2026-09-03", "BOM", "AI", 8000.0, True), ("2026-09-03", "BLR", "6E", None, False), ("2026-09-03", "BLR", "AI", None, False),
]


def points(spark, q, weights=((("DEL", "BOM", 7), 0.6), (("DEL", "BLR", 7), 0.4))):
    w = spark.createDataFrame([("s", *k, v) for k, v in weights], "scenario string, origin string, destination string, lead_time_days int, weight double")
    days, universe = elementary.calendar(q), elementary.strata(q)
    imputed = imputation.impute(elementary.jevons_relatives(elementary.item_prices(q), days, universe))
    levels = chain.chain(imputed, days, universe)
    return imputed, levels, aggregate.index_points(levels, w)


def test_worked_example(spark):
    imputed, _, p = points(spark, quotes(spark, EXAMPLE))
    rel = {(r.destination, r.collection_date.day): r for r in imputed.collect()}
    assert abs(rel["BOM", 2].relative - math.sqrt(1.25)) < 1e-12 and abs(rel["BLR", 2].relative - math.sqrt(0.99)) < 1e-12
    assert abs(rel["BLR", 3].relative_used - math.sqrt(1.10)) < 1e-12 and rel["BLR", 3].imputation_tier == C.TIER_LEAD
    got = sorted((r.collection_date.day, r.index_value, r.observed_weight_share) for r in p.collect())
    for (d, v, s), (wd, wv, ws) in zip(got, [(1, 100.0, 1.0), (2, 106.8815368093, 1.0), (3, 112.0983015116, 0.6)], strict=True):
        assert d == wd and abs(v - wv) < 1e-9 and abs(s - ws) < 1e-12


def test_jevons_is_neither_dutot_nor_carli(spark):
    imputed, _, _ = points(spark, quotes(spark, EXAMPLE))
    rel = next(r.relative for r in imputed.collect() if r.destination == "BOM" and r.collection_date.day == 2)
    assert abs(rel - 13000 / 12000) > 1e-3 and abs(rel - (1.25 + 1) / 2) > 1e-3


def test_time_reversal(spark):
    q = quotes(spark, [r for r in EXAMPLE if r[0] < "2026-09-03"])
    back = q.withColumn("collection_date", F.when(F.dayofmonth("collection_date") == 1, F.lit("2026-09-02")).otherwise(F.lit("2026-09-01")).cast("date"))
    a = {r.destination: r.relative for r in points(spark, q)[0].collect()}
    b = {r.destination: r.relative for r in points(spark, back)[0].collect()}
    assert all(abs(a[k] * b[k] - 1) < 1e-12 for k in a)


def test_cheapest_quote_of_an_item_wins(spark):
    q = quotes(spark, [*EXAMPLE, ("2026-09-01", "BOM", "6E", 3500.0, True)])
    assert {r.total_fare for r in elementary.item_prices(q).where("destination = 'BOM' and carrier = '6E' and day(collection_date) = 1").collect()} == {3500.0}


def test_zero_price_stops_the_run(spark):
    with pytest.raises(PySparkException):
        elementary.item_prices(quotes(spark, [*EXAMPLE, ("2026-09-01", "BOM", "UK", 0.0, True)])).collect()


def test_items_without_carrier_go(spark):
    q = quotes(spark, [*EXAMPLE, ("2026-09-01", "BOM", None, 10.0, True)])
    assert elementary.item_prices(q).where("carrier is null").count() == 0


def test_blackout_day_leaves_a_gap_and_no_flat_line(spark):
    rows = [("2026-09-01", "BOM", "6E", 4000.0, True), ("2026-09-02", "BOM", "6E", None, False), ("2026-09-03", "BOM", "6E", 4400.0, True), ("2026-09-04", "BOM", "6E", 4840.0, True)]
    _, levels, p = points(spark, quotes(spark, rows), ((("DEL", "BOM", 7), 1.0),))
    assert sorted(r.collection_date.day for r in p.collect()) == [1, 4]
    # two days have no match; the level is held, and chaining goes on from it
    assert {r.collection_date.day: r.stratum_index for r in levels.collect()}[4] == pytest.approx(110.0)


def test_one_day_is_too_few(spark):
    with pytest.raises(ValueError):
        check_buildable(quotes(spark, EXAMPLE[:4]))


def test_orphan_strata_and_double_weights_are_refused(spark):
    _, levels, _ = points(spark, quotes(spark, EXAMPLE))
    w = spark.createDataFrame([("s", "DEL", "BOM", 7, 1.0)], "scenario string, origin string, destination string, lead_time_days int, weight double")
    with pytest.raises(ValueError, match="doesn't hold"):
        aggregate.check_orphans(levels, w)
    with pytest.raises(ValueError, match="twice"):
        aggregate.check_orphans(levels, w.union(w))


def test_scenarios(spark):
    dimensions.check_scenarios()
    dimensions.check_basket(dimensions.basket_weights(dimensions.routes(spark), dimensions.scenarios(spark)))
    with pytest.raises(ValueError):
        dimensions.check_scenarios({"x": {1: 1.0}})
    with pytest.raises(ValueError):
        dimensions.check_scenarios({"x": {**C.SCENARIOS["uniform"], 1: 0.3}})
    with pytest.raises(KeyError):
        dimensions.scenario("nope")
    assert C.SCENARIOS["near_term_heavy"][1] > C.SCENARIOS["uniform"][1] > C.SCENARIOS["advance_heavy"][1]


def _panel(spark, days=12, items=6, seed=1, missing=0.0):
    rng = np.random.default_rng(seed)
    price = rng.uniform(3000, 8000, items)
    rows, table = [], np.full((days, items), np.nan)
    for t in range(days):
        price = price * np.exp(rng.normal(0, 0.05, items))
        for i in range(items):
            if rng.random() >= missing:
                table[t, i] = price[i]
                rows.append(((date(2026, 1, 1) + timedelta(days=t)).isoformat(), "BOM", f"C{i}", float(price[i]), True))
    return quotes(spark, rows), np.log(table)


def _geks(ln, window):
    days = len(ln)
    pair = lambda a, b: np.nanmean(ln[b] - ln[a]) if a != b and np.isfinite(ln[b] - ln[a]).any() else (0.0 if a == b else np.nan)
    levels = {}
    for end in range(window, days + 1):
        w = range(end - window, end)
        g = {t: np.nanmean([pair(k, t) - pair(k, w[0]) for k in w]) for t in w}
        if not levels:
            levels = dict(g)
        else:
            levels[end - 1] = g[end - 1] + np.mean([levels[d] - g[d] for d in list(w)[:-1]])
    return 100 * np.exp([levels[d] for d in range(days)])


def test_geks_equals_a_plain_loop(spark):
    q, ln = _panel(spark, missing=0.2)
    b = build(q)
    got = [r.geks_index for r in b.geks(5).orderBy("collection_date").collect()]
    assert np.allclose(got, _geks(ln, 5), rtol=1e-9)


def test_with_constant_items_all_constructions_agree(spark):
    q, ln = _panel(spark)
    b = build(q)
    want = 100 * np.exp((ln - ln[0]).mean(axis=1))
    assert np.allclose([r.direct_index for r in b.direct().orderBy("collection_date").collect()], want)
    assert np.allclose([r.geks_index for r in b.geks(12).orderBy("collection_date").collect()], want)
    levels = b.levels.orderBy("collection_date").collect()
    assert np.allclose([r.stratum_index for r in levels], want)


def test_bilateral_matrix_is_antisymmetric_and_bounded(spark):
    q, _ = _panel(spark, missing=0.3)
    b = build(q)
    m = {(r.a, r.b): r.ln_p for r in multilateral.bilateral_matrix(b.items, b.days, 4).collect()}
    assert all(abs(m[x, y] + m[y, x]) < 1e-12 and abs(x - y) < 4 for x, y in m)


def test_drift_of_few_days_is_a_note(spark):
    q, _ = _panel(spark, days=2)
    b = build(q)
    base = b.levels.select("collection_date", F.col("stratum_index").alias("index_value"))
    r = multilateral.drift(base, b.geks(), b.direct()).first()
    assert r.n == 2 and r.gap_trend_pts_per_day is None and r.reading.startswith("too few")


def test_resample_fills_empty_periods(spark):
    rows = [("2024-01-01", 100.0), ("2024-01-02", 121.0), ("2024-01-07", 110.0), ("2024-01-22", 130.0)]
    p = spark.createDataFrame([(date.fromisoformat(d), "uniform", v, 0.5, 1.0) for d, v in rows], "collection_date date, scenario string, index_value double, availability_rate double, observed_weight_share double")
    got = [(r.collection_date.isoformat(), r.index_value, r.days_in_period) for r in aggregate.resample(p, "W").orderBy("collection_date").collect()]
    assert [(d, n) for d, _, n in got] == [("2024-01-07", 3), ("2024-01-14", 0), ("2024-01-21", 0), ("2024-01-28", 1)]
    assert got[0][1] == pytest.approx((100 * 121 * 110) ** (1 / 3)) and got[1][1] is None
    assert aggregate.resample(p, "MS").first().days_in_period == 4
    with pytest.raises(ValueError):
        aggregate.resample(p, "D")


def test_band_and_availability(spark):
    b = build(quotes(spark, EXAMPLE).withColumn("source", F.lit("x")))
    band = b.band().collect()
    assert all(r.band_low <= r.uniform <= r.band_high for r in band)
    a = {r.collection_date.day: r for r in b.availability.collect()}
    assert (a[3].cells_priced, a[3].cells_sold_out, a[3].cells_blocked, a[3].cells_in_basket) == (1, 1, 0, 120)
