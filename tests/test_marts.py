import json
from datetime import date, datetime
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexloom.functions import constants as C
from indexloom.functions import dimensions, fares
from indexloom.operators import basket, collection, contracts, diagnostics, hedonic, quality, vintages
from indexloom.sources import benchmarks, offers, quotes, sinks
from indexloom.sources import by_header
from indexloom.streaming import ingest

GOOD = {"collection_date": "2026-09-01", "source": "ixigo", "origin": "DEL", "destination": "BOM", "lead_time_days": 7, "dep_date": "2026-09-08", "is_available": True, "total_fare": 5432.0, "currency": "INR", "unavailable_reason": None}
SCHEMA = "collection_date string, source string, origin string, destination string, lead_time_days int, dep_date string, is_available boolean, total_fare double, currency string, unavailable_reason string"


def row(spark, **changes):
    r = GOOD | changes
    return spark.createDataFrame([tuple(r.values())], SCHEMA)


@pytest.mark.parametrize(
    ("changes", "rule"),
    [
        ({"lead_time_days": 3, "dep_date": "2026-09-04"}, "lead_time_days"), ({"origin": "del"}, "origin"), ({"origin": "BOM"}, "not_to_itself"), ({"total_fare": 120.0}, "available_is_priced"), ({"total_fare": 900000.0}, "available_is_priced"),
        ({"total_fare": None}, "available_is_priced"), ({"is_available": False, "total_fare": None, "unavailable_reason": "dunno"}, "unavailable_has_reason"), ({"currency": "USD"}, "currency"), ({"dep_date": "2026-09-20"}, "departs_after_lead_time"),
    ],
)
def test_broken_contracts(spark, changes, rule):
    df = row(spark, **changes)
    rules = contracts.quote_rules(df.columns)
    assert [r.rule for r in contracts.violations(df, rules).collect()] == [rule]
    with pytest.raises(ValueError, match=rule):
        contracts.enforce(df, rules)


def test_good_rows_pass(spark):
    for df in (row(spark), row(spark, is_available=False, total_fare=None, unavailable_reason="sold_out"), row(spark, total_fare=800.0), row(spark, total_fare=150000.0)):
        assert contracts.enforce(df, contracts.quote_rules(df.columns)) is df
    df = row(spark, is_available=False, total_fare=None).drop("unavailable_reason")
    contracts.enforce(df, contracts.quote_rules(df.columns))


def test_index_contract(spark):
    schema = "collection_date string, scenario string, index_value double, availability_rate double, observed_weight_share double"
    ok = ("2026-09-01", "uniform", 101.0, 0.9, 1.0)
    contracts.enforce(spark.createDataFrame([ok], schema), contracts.index_rules(), ["collection_date", "scenario"])
    for bad in ((*ok[:3], None, 1.0), ("2026-09-01", "x", *ok[2:]), (*ok[:2], 0.0, 0.9, 1.0)):
        with pytest.raises(ValueError):
            contracts.enforce(spark.createDataFrame([bad], schema), contracts.index_rules())
    with pytest.raises(ValueError, match="unique"):
        contracts.enforce(spark.createDataFrame([ok, ok], schema), contracts.index_rules(), ["collection_date", "scenario"])


def test_not_null_values_and_ranges(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (9, None)], "n int, s string")
    assert contracts.not_null(df, "n").count() == 1
    assert [r.s for r in contracts.accepted_values(df, "s", ["a"]).collect()] == ["b"]
    assert [r.n for r in contracts.accepted_range(df, "n", 0, 5).collect()] == [9]


def test_normalise(spark):
    raw = spark.createDataFrame([("2026-09-01", " TRUE ", "12.5", "7", " del", "bom ", None), ("bad", "no", "x", "7.0", "DEL", "BOM", "6E"), ("2026-09-01", "1", "NaN", None, "DEL", "BOM", "6E")], "collection_date string, is_available string, total_fare string, lead_time_days string, origin string, destination string, carrier string")
    got = [tuple(r) for r in quotes.normalise(raw).select("collection_date", "is_available", "total_fare", "lead_time_days", "origin", "destination", "carrier", "dep_ts").collect()]
    assert got == [(date(2026, 9, 1), True, 12.5, 7, "DEL", "BOM", "UNKNOWN", None), (None, False, None, 7, "DEL", "BOM", "6E", None)]


def test_simulated_quotes_are_refused(spark):
    s = spark.createDataFrame([("SIMULATED_a", 1, True)], "source string, v int, is_simulated boolean")
    with pytest.raises(ValueError):
        quotes.reject_simulated(s)
    quotes.reject_simulated(s.withColumn("source", F.lit("a")).drop("is_simulated"))
    with pytest.raises(ValueError):
        quotes.require_columns(s, ["flight_no"])


def test_dedupe_keeps_the_first_of_a_key(spark):
    schema = "quote_id long, collection_ts_utc timestamp_ntz, collection_date date, source string, origin string, destination string, lead_time_days int, carrier string, flight_no string, dep_date date, dep_ts timestamp_ntz, total_fare double, is_available boolean, unavailable_reason string"
    base = (date(2026, 9, 1), "s", "DEL", "BOM", 7, None, None, date(2026, 9, 8), datetime(2026, 9, 5, 20, 0), 5000.0, True, None)
    df = spark.createDataFrame([(2, datetime(2026, 9, 1, 5), *base), (1, datetime(2026, 9, 1, 5), *base), (3, datetime(2026, 9, 1, 4), *base)], schema)
    r = quality.stage(df).collect()
    assert [x.quote_id for x in r] == [3] and r[0].dep_ts_ist == datetime(2026, 9, 6, 1, 30) and r[0].dep_dow == 0 and r[0].dep_hour == 1 and r[0].route == "DEL-BOM"


def test_revisions_compare_nulls_as_values(spark):
    t = lambda h: datetime(2026, 9, 1, h)
    v = spark.createDataFrame([(date(2026, 9, 1), "u", "h", t(h), x) for h, x in ((1, 100.0), (2, 100.0), (3, None), (4, None), (5, 101.5))], "collection_date date, scenario string, series string, computed_at_utc timestamp_ntz, index_value double")
    got = sorted((r.from_vintage, r.to_vintage, r.first_value, r.later_value) for r in vintages.revisions(v).collect())
    assert got == [(2, 3, 100.0, None), (4, 5, None, 101.5)]
    assert vintages.latest(v).first().index_value == 101.5
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, n int")
    assert {tuple(r) for r in vintages.upsert_runs(runs, spark.createDataFrame([("b", 3)], "run_id string, n int")).collect()} == {("a", 1), ("b", 3)}


def test_vintages_are_appended_once(spark, tmp_path):
    v = spark.createDataFrame([(date(2026, 9, 1), "u", "h", datetime(2026, 9, 1, 1), 100.0)], "collection_date date, scenario string, series string, computed_at_utc timestamp_ntz, index_value double")
    folder = str(tmp_path / "v")
    for _ in range(2):
        assert sinks.append_vintage(v, folder).count() == 1
    later = v.withColumn("computed_at_utc", F.lit(datetime(2026, 9, 2)).cast("timestamp_ntz")).withColumn("index_value", F.lit(99.0))
    assert sinks.append_vintage(later, folder).first().index_value == 99.0 and spark.read.parquet(folder).count() == 2


def test_outcomes_in_order_of_precedence(spark):
    cases = [(False, "Timeout", "captcha", 3, "robots_disallowed"), (True, "Timeout 30s", "captcha", 3, "timeout"), (True, "net error", "", 0, "parse_error"), (True, None, "Please solve the CAPTCHA", 3, "blocked"), (True, None, "no results here", 3, None), (True, None, "No Results here", 0, "sold_out"), (True, None, "hello", 0, "parse_error"), (True, None, "x" * 20001 + "captcha", 1, None)]
    df = spark.createDataFrame(cases, "ok boolean, err string, page string, n int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", collection.outcome(F.col("ok"), F.col("err"), F.col("page"), F.col("n"), head=20_000)).collect())
    assert df.where("length(page) > 20000").select(collection.outcome(F.col("ok"), F.col("err"), F.col("page"), F.col("n"))).first()[0] == "blocked"  # whole pages, unless limited


def test_basket_labels_and_selection(spark):
    t = spark.createDataFrame([("new  delhi", "Mumbai", 10.0, 4.0, 2024, 1), ("Delhi ", "PUNE", 1.0, 1.0, 2024, 2), ("Mumbai", "Mumbai", 9.0, 9.0, 2024, 2), ("Delhi", "Atlantis", 5.0, 5.0, 2024, 2)], benchmarks.TRAFFIC)
    cities = spark.createDataFrame([("NEW DELHI", "DEL"), ("DELHI", "DEL"), ("MUMBAI", "BOM"), ("PUNE", "PNQ")], "city string, code string")
    d = basket.directed_pax(basket.map_cities(t, cities))
    assert {tuple(r) for r in d.collect()} == {("DEL", "BOM", 10.0), ("BOM", "DEL", 4.0), ("DEL", "PNQ", 1.0), ("PNQ", "DEL", 1.0)}
    assert [tuple(r) for r in basket.unmapped(t, cities).collect()] == [("ATLANTIS", 10.0)]
    p = basket.select_pairs(basket.pair_volume(d), ["DEL-PNQ"], [], 2)
    assert [(r.pair, r.reason) for r in p.orderBy("place").collect()] == [("DEL-PNQ", "seed"), ("BOM-DEL", "volume")]
    assert basket.weight_drift(basket.basket_routes(d, p), basket.basket_routes(d, p)).count() == 0
    assert basket.trailing(t, 1).select("ym").distinct().first().ym == 202402


def test_fare_functions(spark):
    df = spark.createDataFrame([("₹5,432", "Air India Express", "Non-Stop|6324|10|DEL-BOM||", "DELBOMThu-10Sep202604:0006:15SG 510"), ("Rs. 4999", "AIR INDIA", "1 stop|7000|x|DEL-BOM", "?"), ("4,00,000", "SG", "bad", None), ("12abc", "nothing", None, ""), ("5432.50", "flight 6e-2043", "", "")], "f string, c string, sd string, seg string")
    r = df.select(fares.parse_inr(F.col("f")).cast("double").alias("f"), fares.detect_carrier(F.col("c")).alias("c"), fares.detect_flight_no(F.col("c")).alias("n"), fares.sd_parts(F.col("sd")).alias("sd"), fares.segment_parts(F.col("seg")).alias("seg"), fares.carrier_shown(F.col("c")).alias("shown")).collect()
    assert [x.f for x in r] == [5432.0, 4999.0, 400000.0, None, 5432.5]
    assert [x.c for x in r] == ["IX", "AI", "SG", None, "6E"] and r[4].n == "6E2043" and [x.shown for x in r][:2] == ["IX", "AI"]
    assert (float(r[0].sd.total_fare), r[0].sd.stops, r[1].sd.stops, r[2].sd) == (6324.0, 0, 1, None)
    assert (r[0].seg.carrier, r[0].seg.flight_no, r[0].seg.dep_ts) == ("SG", "SG510", datetime(2026, 9, 10, 4, 0)) and r[1].seg is None


NESTED = {"data": {"searchResult": {"tripInfos": {"ONWARD": [
    {"sI": [{"fD": {"aI": {"code": "6E"}, "fN": "2043"}}], "totalPriceList": [{"fd": {"ADULT": {"fC": {"TF": 5432, "BF": 4100, "TAF": 1332}}}}]},
    {"sI": [{"fD": {"aI": {"code": "AI"}, "fN": "101"}}], "totalPriceList": [{"fd": {"ADULT": {"fC": {"TF": 7890, "BF": 6000, "TAF": 1890}}}}]},
]}}}}
FLAT = {"Results": [{"AirlineCode": "SG", "FlightNumber": "SG-8169", "TotalFare": 6245, "Stops": 1}, {"AirlineCode": "QP", "FlightNumber": "QP 1102", "TotalFare": "4,875", "Stops": 0}]}
BURIED = {"a": {"b": {"c": {"d": {"e": {"f": {"marketingAirline": "Akasa Air QP-1301", "displayPrice": {"amount": 5199}}}}}}}}


def test_json_offers(spark):
    docs = [(1, json.dumps(NESTED)), (2, json.dumps(FLAT)), (3, json.dumps(BURIED)), (4, json.dumps({"x": [{"price": 5000}]})), (5, json.dumps({"airline": "6E", "fare": 299})), (6, json.dumps({"airline": "6E", "fare": 999999})), (7, "not json"), (8, None)]
    got = {}
    for r in offers.json_offers(spark.createDataFrame(docs, "doc_id long, payload string")).collect():
        got.setdefault(r.doc_id, []).append((r.total_fare, r.carrier, r.flight_no, r.stops))
    assert sorted(x[:2] for x in got[1]) == [(5432.0, "6E"), (7890.0, "AI")]
    assert sorted(got[2]) == [(4875.0, "QP", "QP1102", 0), (6245.0, "SG", "SG8169", 1)]
    assert got[3][0][:2] == (5199.0, "QP") and set(got) == {1, 2, 3}


def test_json_offers_are_found_within_the_payload(spark):
    """No shuffle of nodes; payloads that share an id, or have none, stay apart; signs of offers side by side don't mix."""
    other = {"Results": [{"AirlineCode": "6E", "TotalFare": 7000}]}
    beside = {"a": [{"airline": {"code": 5, "name": "IndiGo"}, "p": [{"TF": 0}, {"TF": 4100, "fare": 1100}]}, {"fare": 3000}, {"x": {"carrier": "AI 101", "stops": [1, 2]}, "price": 5200, "std": "04:00"}]}
    docs = [(1, json.dumps(FLAT)), (1, json.dumps(other)), (None, json.dumps(other)), (2, json.dumps(beside))]
    got = offers.json_offers(spark.createDataFrame(docs, "doc_id long, payload string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r.doc_id or 0, r.total_fare, r.carrier, r.flight_no, r.stops, r.dep_raw) for r in got.collect()) == [(0, 7000.0, "6E", None, None, None), (1, 4875.0, "QP", "QP1102", 0, None), (1, 6245.0, "SG", "SG8169", 1, None), (1, 7000.0, "6E", None, None, None), (2, 4100.0, "6E", None, None, None), (2, 5200.0, "AI", "AI101", None, "04:00")]


def test_page_offers(spark):
    hit = "<div><div class=row><span>IndiGo</span> <b>6E-2043</b> 04:00 <i>₹5,432</i></div><p>₹9,999 only</p></div>"
    rows = "<ul>" + "".join(f"<li><span>{n}</span><span>{p}</span></li>" for n, p in (("Mystery Airlines here", "₹4,100"), ("Air India Express", "₹5,200"), ("IndiGo flight", "₹299"), ("IndiGo flight", "₹4,00,000"))) + "</ul>"
    pages = spark.createDataFrame([(1, hit), (2, "<p>₹5,432 and ₹6,000</p>"), (3, None)], "doc_id long, payload string")
    assert [(r.doc_id, r.total_fare, r.carrier, r.flight_no) for r in offers.page_offers(pages).collect()] == [(1, 5432.0, "6E", "6E2043")]
    found = [(r.total_fare, r.carrier) for r in offers.page_rows(spark.createDataFrame([(1, rows)], "doc_id long, payload string")).collect()]
    assert found[0] == (4100.0, "IX") or (5200.0, "IX") in found
    assert (4100.0, None) in found and all(f not in (299.0, 400000.0) for f, _ in found)


def test_page_rows_parses_each_page_once(spark):
    """Pages with rows give rows only, others their offers, each once, whatever white space stands in a text."""
    row = "<li><span>Air India Express</span> <span>₹5,200</span></li>"
    offer = "<div><b>6E-2043</b> 04:00 <i>Rs 5,432</i></div>"
    wide = "<p>IndiGo" + " \n" * 900 + "6E-777 INR 6,000</p>"
    pages = spark.createDataFrame([(1, f"<ul>{row}{row}</ul>{offer}"), (2, f"{offer}{offer}{wide}"), (3, None), (4, "<p>nothing</p>")], "doc_id long, payload string")
    got = offers.page_rows(pages)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert sorted((r.doc_id, r.total_fare, r.carrier, r.flight_no) for r in got.collect() if r.flight_no or r.carrier) == [(1, 5200.0, "IX", None), (2, 5432.0, "6E", "6E2043"), (2, 6000.0, "6E", "6E777")]
    assert got.where("doc_id > 2").count() == 0


def test_page_rows_are_found_within_the_page(spark):
    """No shuffle, for rows and offers; pages that share an id stay apart: one's rows don't hide another's offers."""
    row, offer = "<li><span>Air India Express</span> <span>₹5,200</span></li>", "<div><b>6E-2043</b> 04:00 <i>Rs 5,432</i></div>"
    pages = spark.createDataFrame([(1, f"<ul>{row}{row}</ul>{offer}"), (1, offer + offer), (2, "")], "doc_id long, payload string")
    rows, shown = offers.page_rows(pages), offers.page_offers(pages)
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (rows, shown))
    assert sorted((r.doc_id, r.total_fare, r.carrier, r.flight_no) for r in rows.collect() if r.carrier) == [(1, 5200.0, "IX", None), (1, 5432.0, "6E", "6E2043")]
    assert sorted((r.doc_id, r.total_fare, r.flight_no) for r in shown.collect()) == [(1, 5432.0, "6E2043")] * 2


def test_plain_markup_is_read_as_the_library_reads_it():
    class ByLibrary(offers._Blocks):
        goahead = HTMLParser.goahead

    odd = ["<p a=b/>x", "<p a='>' disabled>x", '<div\x0bclass="a">x</div\x0b>', "<br/>x<p />y", "<script>var t = '</p>'; a<b</script>x", "<STYLE>a{}</style>x", "<script>x</style></script>y", "<script><!-- <b> --></script>x", "<script/>x", "<!---->x", "<!-->x", "<!-- a - b -->x", "<!-- a -- b -->x", "<!DOCTYPE html>x", "<?pi?>x", "</ p>x", "</p x>", "< b", "&amp;&#8377;4,100 &am", '<p a="', "<title>a<b>c</title>", "<", "</>"]
    for x in odd:
        for page in (x, f"<div>{x}", f"{x}<p>y</p></div> z", f"<div>{x}<p>y</p></div> z"):
            assert offers._Blocks(page, 400).done == ByLibrary(page, 400).done, page


def test_unreadable_payloads_are_counted(spark):
    deep = "[" * 100_000 + "]" * 100_000
    p = spark.createDataFrame([(1, "{"), (2, deep), (3, "{}"), (4, None), (5, ""), (6, '{"fare": 5000, "airline": "6E 1"}')], "doc_id long, payload string")
    assert sorted(map(tuple, offers.unreadable(p).collect())) == [(1, "no JSON"), (2, "nested beyond the parser's depth")]
    assert [r.doc_id for r in offers.json_offers(p).collect()] == [6]


def test_keys_and_numbers_at_any_depth(spark):
    x = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": {"i": 2500}}}}}}}}, "l": [{"k": [[{"m": 1}, {"no": 1}]]}, {"no": [{"no2": 1}]}]}
    p = spark.createDataFrame([(1, json.dumps(x))], "doc_id long, payload string")
    assert [r.number for r in offers.numbers(p).collect()] == [2500.0] and offers.numbers(p, depth=8).count() == 0
    assert sorted(r.key for r in offers.top_keys(p).collect()) == list("abcdefghiklm")
    assert sorted(r.key for r in offers.top_keys(p, depth=2).collect()) == list("abkl")


def test_offers_within_offers_and_prices_that_are_objects(spark):
    price = {"Airline": "IndiGo", "fare": {"amount": 0, "value": 5400}}
    docs = [(1, json.dumps({"a": price})), (2, json.dumps({"a": {**price, "options": [{"carrier": "AI 202", "TotalFare": 6100}]}})), (3, "["), (4, None)]
    got = sorted((r.doc_id, r.total_fare, r.carrier, r.flight_no) for r in offers.json_offers(spark.createDataFrame(docs, "doc_id long, payload string")).collect())
    assert got == [(1, 5400.0, "6E", None), (2, 6100.0, "AI", "AI202")]


def test_journey_offers(spark):
    it = lambda sd, key, b="1": {"SD": sd, "segMatchingKey": key, "SeatAv": "9", "FareTypeUI": "x", "b": [{"stp": b}]}
    known = {"CFee": 300, "j": [{"s": [it("Non-Stop|6324|10|DEL-BOM||", "DELBOMThu-10Sep202604:0006:15SG 510"), it("1 stop|7000|2|BOM-DEL||", "BOMDELThu-10Sep202604:0006:15SG 511"), it("Non-Stop||1|DEL-BOM||", "DELBOMThu-10Sep202604:0006:15SG 512"), it("direct flight|5000|1|DEL-BOM||", "", "2")]}]}
    p = spark.createDataFrame([(1, json.dumps(known), "DEL", "BOM"), (2, json.dumps(FLAT), "DEL", "BOM")], "doc_id long, payload string, origin string, destination string")
    got = sorted((r.doc_id, r.total_fare, r.carrier or "", r.flight_no or "", r.stops, r.dep_raw or "") for r in offers.journey_offers(p).collect())
    assert got[:2] == [(1, 5000.0, "", "", 2, ""), (1, 6324.0, "SG", "SG510", 0, "2026-09-10 04:00")] and len(got) == 4


def test_journey_payloads_are_parsed_once(spark):
    """One branch for both kinds of payloads, and no shuffle."""
    known = {"j": [{"s": [{"SD": "Non-Stop|6324|10|DEL-BOM||", "segMatchingKey": "DELBOMThu-10Sep202604:0006:15SG 510"}]}], "also": FLAT}
    p = spark.createDataFrame([(1, json.dumps(known), "DEL", "BOM"), (2, json.dumps(FLAT), "DEL", "BOM"), (3, "{", "DEL", "BOM"), (4, None, "DEL", "BOM"), (5, json.dumps(known), "DEL", "BLR")], "doc_id long, payload string, origin string, destination string")
    got = offers.journey_offers(p)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r.doc_id, r.total_fare, r.flight_no) for r in got.collect()) == [(1, 6324.0, "SG510"), (2, 4875.0, "QP1102"), (2, 6245.0, "SG8169"), (5, 4875.0, "QP1102"), (5, 6245.0, "SG8169")]


def test_other_walks(spark):
    p = spark.createDataFrame([(1, json.dumps({"a": [1500, 50, {"b": 2000.5}], "c": True, "d": "3000", "e": [{"x.y": 1}, {"z": {"u": [[2000]]}}]})), (2, "[")], "doc_id long, payload string")
    assert [r.number for r in offers.numbers(p).orderBy("path").collect()] == [1500.0, 2000.5, 2000.0]
    assert [r.number for r in offers.numbers(p, depth=3).orderBy("path").collect()] == [1500.0, 2000.5]
    assert sorted(r.key for r in offers.top_keys(p).collect()) == ["a", "c", "d", "e", "x.y"]
    df = spark.createDataFrame([('{"a": 1, "b": [{"c": "x"}]}',), ('{"a": 2}',)], "payload string")
    assert "a" in offers.skeleton(df).first().skeleton


def test_hedonic_equals_a_row_level_fit(spark):
    rng = np.random.default_rng(3)
    rows = []
    routes = C.ROUTES[:3]
    for d in range(8):
        for o, dst, _ in routes:
            for lead in (1, 7):
                for k, car in enumerate(("6E", "AI", "SG")):
                    for _ in range(int(rng.integers(1, 4))):
                        y = 8 + 0.1 * k + 0.02 * d + rng.normal(0, 0.1)
                        rows.append((date(2026, 9, 1 + d), o, dst, lead, car, float(np.exp(y)), True, datetime(2026, 9, 10 + int(rng.integers(0, 5)), int(rng.integers(0, 24))), date(2026, 9, 10)))
    q = spark.createDataFrame(rows, "collection_date date, origin string, destination string, lead_time_days int, carrier string, total_fare double, is_available boolean, dep_ts timestamp_ntz, dep_date date")
    weights = dimensions.routes(spark)
    r = hedonic.fit(q, weights, C.SCENARIOS["uniform"])
    assert r.terms_dropped == ["is_holiday"]
    df = hedonic.with_weights(hedonic.prepare(q), weights, C.SCENARIOS["uniform"]).toPandas()
    cols = [np.ones(len(df))]
    names = [None]
    for t in [*r.terms_used, "collection_date"]:
        for level in sorted(df[t].unique())[1:]:
            cols.append((df[t] == level).to_numpy(float))
            names.append((t, level))
    x, w, y = np.stack(cols, 1), df["_w"].to_numpy(), df["log_fare"].to_numpy()
    inv = np.linalg.pinv(x.T @ (x * w[:, None]))
    beta = inv @ (x.T @ (w * y))
    e = y - x @ beta
    k = np.linalg.matrix_rank(x)
    se = np.sqrt(np.diag(inv @ (x.T @ (x * (w * e)[:, None] ** 2)) @ inv) * len(y) / (len(y) - k))
    got = {s.collection_date: s for s in r.series.collect()}
    for name, b, s in zip(names, beta, se, strict=True):
        if name and name[0] == "collection_date":
            assert got[name[1]].hedonic_index == pytest.approx(100 * np.exp(b), rel=1e-9) and got[name[1]].se == pytest.approx(s, rel=1e-7)
    assert r.n_observations == len(rows) and hedonic.fit(q.limit(30)) is None


def test_hedonic_without_departures_uses_dates_and_holidays(spark):
    q = spark.createDataFrame([(date(2026, 9, 1), "DEL", "BOM", 7, "6E", 5000.0, True, None, date(2026, 9, 12))], "collection_date date, origin string, destination string, lead_time_days int, carrier string, total_fare double, is_available boolean, dep_ts timestamp_ntz, dep_date date")
    r = hedonic.prepare(q, spark.createDataFrame([(date(2026, 9, 12),)], "day date")).first()
    assert (r.dep_dow, r.dep_hour_band, r.is_holiday) == (5, "unknown", 1)


def test_benchmark_exports(spark):
    a = benchmarks.normalise_export(spark.createDataFrame([("2024", "Jan", "101.5"), ("2024", "2", "x"), ("2024", "March", "103")], "Year string, Month string, `CPI Index` string"))
    assert sorted((r.month.isoformat(), r.cpi_index) for r in a.collect()) == [("2024-01-01", 101.5), ("2024-03-01", 103.0)]
    b = benchmarks.normalise_export(spark.createDataFrame([("2024-05-17", "7")], "Period string, Value string"))
    assert b.first().month == date(2024, 5, 1)
    for bad in ("a string, b string", "Date string, b string"):
        with pytest.raises(ValueError):
            benchmarks.normalise_export(spark.createDataFrame([("x", "y")], bad))


def test_agreement_below_five_days_is_empty(spark):
    f = spark.createDataFrame([(date(2024, 1, d), 100.0 + d) for d in range(1, 4)], "collection_date date, v double")
    r = diagnostics.agreement({"a": f, "b": f}).first()
    assert r.n_days == 3 and r.corr_of_log_changes is None
    assert diagnostics.weakest_pair(diagnostics.agreement({"a": f, "b": f}, 2)).first().pair == "a_vs_b"


def test_csv_round_trip_resume_and_stream(spark, tmp_path):
    day = spark.createDataFrame([("2026-09-01", "s", "DEL", "BOM", "7", "6E", "5000", "true"), ("2026-09-01", "s", "DEL", "BLR", "7", "6E", None, "false")], "collection_date string, source string, origin string, destination string, lead_time_days string, carrier string, total_fare string, is_available string")
    folder = str(tmp_path / "raw")
    sinks.append_quotes(day, folder)
    sinks.append_quotes(day, folder)
    back = quotes.normalise(quotes.read_csv(spark, folder + "/day=2026-09-01"))
    assert back.count() == 4 and back.where("is_available").first().total_fare == 5000.0
    (tmp_path / "raw" / "day=2026-09-01" / "cut.csv").write_text(",".join(quotes.COLUMNS) + "\nr,1,2026-09-01T00:00:00,2026-09-01,s,u,DEL,GA")
    done = collection.already_collected(quotes.read_csv(spark, folder + "/day=2026-09-01"))
    assert {tuple(r) for r in done.collect()} == {("s", "DEL", "BOM", 7), ("s", "DEL", "BLR", 7)}
    cells = dimensions.cells(spark, "2026-09-01").withColumn("source", F.lit("s"))
    assert collection.still_to_collect(cells, done).count() == 118
    seen = []
    q = ingest.run(ingest.quote_files(spark, folder), str(tmp_path / "store"), str(tmp_path / "cp"), lambda df, days: seen.append((df.count(), days)))
    q.awaitTermination()
    assert seen and seen[-1][0] == 4 and seen[-1][1] == [date(2026, 9, 1)]


def test_windowed_counts_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [",".join(quotes.COLUMNS)] + [f"r,1,2026-09-01 0{h}:30:00,2026-09-01,s,u,DEL,BOM,7" + "," * 14 + "true,," for h in (1, 1, 2)]
    (src / "a.csv").write_text("\n".join(lines))
    ingest.run(ingest.quote_files(spark, str(src)), str(tmp_path / "store"), str(tmp_path / "landing")).awaitTermination()
    q = ingest.windowed_counts(ingest.landed(spark, str(tmp_path / "store"))).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.window.start.hour, r.quotes) for r in spark.table("counts").collect()) == [(1, 2), (2, 1)]


def test_outputs_and_content_hash(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 2), 1.0), (date(2024, 1, 1), None)], "collection_date date, v double")
    sinks.write_outputs({"x": df}, str(tmp_path / "out"), "abc")
    got = spark.read.option("header", True).csv(str(tmp_path / "out" / "x"))
    assert got.columns == ["collection_date", "v", "computed_at_utc", "code_version"] and got.count() == 2
    h = lambda d: sinks.content_hash(d, ["collection_date", "v"]).first().sha256
    assert h(df) == h(df.orderBy("collection_date")) != h(df.limit(1))


def test_health_and_alarm(spark):
    today = date(2026, 9, 10)
    df = spark.createDataFrame([(date(2026, 9, 9), 0.9), (date(2026, 9, 9), 0.5), (date(2026, 9, 8), 0.9), (date(2026, 9, 1), 0.9)], "d date, availability_rate double")
    assert [r.s for r in df.select(collection.health_status(F.col("d"), F.col("availability_rate"), F.lit(today)).alias("s")).collect()] == ["healthy", "degraded", "degraded", "stale"]
    with pytest.raises(RuntimeError):
        collection.stop_below(df)
    e = spark.createDataFrame([(today, {"a": (1, 2)})], "collection_date date, per_source map<string, struct<cells_attempted:int,cells_available:int>>")
    assert tuple(collection.explode_health(e).first()) == (today, "a", 1, 2)


def test_csv_files_with_different_headers(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "2026-09-01.csv").write_text("source,origin,destination,lead_time_days,total_fare,is_available\ns,DEL,BOM,7,5000,true\n")
    (raw / "2026-09-02.csv").write_text("total_fare,source,carrier,destination,origin,lead_time_days,is_available,extra\n6000,s,6E,BOM,DEL,7,true,x\n")
    (raw / "2026-09-03.csv").write_text("source,origin,destination,lead_time_days,total_fare,is_available\ns,DEL,BLR,1,7000,true\n")
    rows = sorted(tuple(r) for r in quotes.read_csv(spark, str(raw)).select("collection_date", "origin", "destination", "carrier", "total_fare").collect())
    assert rows == [("2026-09-01", "DEL", "BOM", None, "5000"), ("2026-09-02", "DEL", "BOM", "6E", "6000"), ("2026-09-03", "DEL", "BLR", None, "7000")]
    assert len(by_header.headers(spark, str(raw))) == 2
    (raw / "w.txt").write_text("origin,destination,pair,pax,weight\nDEL,BOM,BOM-DEL,10,1.0\n")
    assert quotes.read_weights(spark, str(raw / "w.txt")).first().weight == 1.0


CHECKED = ("2026-09-0{}", "ixigo", "DEL", "BOM", 7, "2026-09-{:02d}", "6E", 5432.0, True, None, "INR")
CHECKED_COLUMNS = "collection_date string, source string, origin string, destination string, lead_time_days int, dep_date string, carrier string, total_fare double, is_available boolean, unavailable_reason string, currency string"


def contract_rows(spark, **over):
    from indexloom.plans.index_build import build

    names = [c.split()[0] for c in CHECKED_COLUMNS.split(", ")]
    rows = [dict(zip(names, CHECKED, strict=True), collection_date=f"2026-09-0{d}", dep_date=f"2026-09-{d + 7:02d}") for d in (1, 2)]
    rows[1].update(over)
    q = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], CHECKED_COLUMNS).withColumn("collection_date", F.col("collection_date").cast("date")).withColumn("dep_date", F.col("dep_date").cast("date"))
    return lambda: build(q, checked=True)


@pytest.mark.parametrize("over", [{"lead_time_days": 3}, {"origin": "del"}, {"destination": "DEL"}, {"total_fare": 120.0}, {"total_fare": 900000.0}, {"total_fare": None}, {"is_available": False, "unavailable_reason": "dunno"}, {"currency": "USD"}, {"dep_date": "2026-09-20"}, {"source": "SIMULATED_x"}, {"collection_date": "2026-09-01", "dep_date": "2026-09-08"}, {"destination": "GOI"}])
def test_a_checked_build_refuses(spark, over):
    with pytest.raises(ValueError):
        contract_rows(spark, **over)()


def test_a_checked_build_takes_good_rows(spark, tmp_path):
    assert contract_rows(spark)().points.count() == 6
    b = contract_rows(spark, is_available=False, total_fare=None, unavailable_reason="sold_out")()
    assert b.availability.count() == 2
    sinks.write_meta(contract_rows(spark)(), str(tmp_path / "meta"), "abc")
    m = spark.read.json(str(tmp_path / "meta")).first()
    assert (m.collection_days, m.first_day, m.latest.index_value, m.code_version) == (2, "2026-09-01", 100.0, "abc") and len(m.imputation_by_day) == 1


def test_stored_outputs_or_a_typed_answer(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    assert sinks.read_stored(spark, str(tmp_path / "x.csv"), "a int, b int").rows.first().b == 2
    gone = sinks.read_stored(spark, str(tmp_path / "none"))
    assert gone.rows is None and "none" in gone.reason


def test_rows_are_written_in_iso_8601(spark):
    df = spark.createDataFrame([(datetime(2026, 9, 1, 4, 5, 6), "5432.50")], "collection_ts_utc timestamp, f string").withColumn("total_fare", F.col("f").cast("decimal(12,2)"))
    r = sinks.as_row(df).first()
    assert r.collection_ts_utc == "2026-09-01T04:05:06Z" and r.total_fare == "5432.50" and r.asDict().keys() == dict.fromkeys(quotes.COLUMNS).keys()


def test_seeds_without_volume_stay_and_are_told(spark):
    d = spark.createDataFrame([("AAA", "BBB", 5.0), ("BBB", "AAA", 4.0), ("AAA", "CCC", 9.0)], "origin string, destination string, pax double")
    p = basket.select_pairs(basket.pair_volume(d), ["AAA-BBB", "XXX-YYY"], ["CCC-ZZZ"], 4)
    assert [(r.pair, r.pax, r.reason) for r in p.orderBy("place").collect()] == [("AAA-BBB", 9.0, "seed"), ("XXX-YYY", None, "seed"), ("CCC-ZZZ", None, "thin"), ("AAA-CCC", 9.0, "volume")]
    with pytest.raises(ValueError, match="without volume"):
        basket.check_selection(p, d, 4)


def test_page_marks_and_fetch_marks(spark):
    df = spark.createDataFrame([("<script src=datadome.js></script> fares", 200), ("please solve a CAPTCHA", 200), ("fine", 429)], "body string, status int")
    got = df.select(collection.outcome(F.lit(True), F.lit(None).cast("string"), F.col("body"), F.lit(3)).alias("page"), collection.fetched_reason(F.col("status"), F.col("body")).alias("body")).collect()
    assert [tuple(r) for r in got] == [(None, "blocked"), ("blocked", "blocked"), (None, "rate_limited")]
