"""Files bound by their headers, whatever the order of their columns, in batch and stream."""

import pytest

from indexloom.sources import benchmarks, by_header, quotes, sinks
from indexloom.streaming import ingest

LINES = {
    "2026-09-01.csv": ["source,origin,destination,lead_time_days,total_fare,is_available", "s,DEL,BOM,7,5000,true", 's,"DEL",BLR,1,,false'],
    "2026-09-02.csv": ["﻿total_fare,source,carrier,destination,origin,lead_time_days,is_available,extra,origin", "6000,s,6E,BOM,DEL,7,true,x,ZZZ"],
    "2026-09-03.csv": ["collection_date,destination,origin,source,lead_time_days,total_fare,is_available\r", "2026-10-01,BOM,DEL,s,7,5100,t\r"],
    "empty.csv": [],
}
WANT = [("2026-09-01", "DEL", "BLR", None, None), ("2026-09-01", "DEL", "BOM", None, 5000.0), ("2026-09-02", "DEL", "BOM", "6E", 6000.0), ("2026-10-01", "DEL", "BOM", None, 5100.0)]


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw files"
    for k, (name, lines) in enumerate(LINES.items()):
        part = folder / f"part{k % 2}"
        part.mkdir(parents=True, exist_ok=True)
        (part / name).write_text("".join(x + "\n" for x in lines))
    return str(folder)


def shown(df):
    return sorted(((str(r.collection_date), r.origin, r.destination, None if r.carrier == "UNKNOWN" else r.carrier, r.total_fare) for r in df.collect()), key=str)


def test_batch_and_stream_agree(spark, raw, tmp_path):
    assert shown(quotes.normalise(quotes.read_csv(spark, raw))) == sorted(WANT, key=str)
    store, seen = str(tmp_path / "store"), []
    for _ in range(2):  # the second time nothing is new
        ingest.run(ingest.quote_files(spark, raw, 1), store, str(tmp_path / "cp"), lambda df, days: seen.append(len(days))).awaitTermination()
    assert shown(spark.read.parquet(store)) == sorted(WANT, key=str) and seen == [1, 1, 1]
    q = ingest.landed(spark, store).writeStream.format("memory").queryName("landed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert shown(spark.table("landed")) == sorted(WANT, key=str)


def test_a_repeated_batch_lands_once(spark, raw, tmp_path):
    store = str(tmp_path / "store")
    for k in range(2):  # as if the driver were lost behind the first write: the batch comes again with the same number
        ingest.run(ingest.quote_files(spark, raw), store, str(tmp_path / f"cp{k}")).awaitTermination()
    assert spark.read.parquet(store).count() == len(WANT)


def test_headers_of_all_files(spark, raw):
    found = by_header.headers(spark, raw)
    assert sorted(len(f) for f in found.values()) == [1, 1, 1]
    assert by_header.names_of("﻿a,\"b,c\",d\r") == ["a", "b,c", "d"]


def test_what_is_read_follows_the_number_of_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "1,2\n" * 300_000)
    before = {s.stageId() for s in stages(spark)}
    assert len(by_header.first_lines(spark, str(tmp_path))) == 3
    assert sum(s.inputBytes() for s in stages(spark) if s.stageId() not in before) == 0  # Spark reads no content for it; tasks take a block of each


def stages(spark):
    every = spark._jsparkSession.sparkContext().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [every.apply(k) for k in range(every.size())]


def test_long_headers_and_other_stores(spark, tmp_path):
    names = [f"column{k}" for k in range(20_000)]
    path = tmp_path / "wide.csv"
    path.write_text(",".join(names) + "\n" + ",".join("7" * 20_000) + "\n")
    assert by_header.names_of(by_header.first_lines(spark, str(path))[0][1]) == names
    assert by_header._first_line("nostore://x/y.csv") is None
    assert by_header._through_spark(spark, f"file://{path}") == ",".join(names)
    (tmp_path / "none.csv").write_text("")
    assert by_header._through_spark(spark, f"file://{tmp_path}/none.csv") == ""


def test_tables_in_any_order(spark, tmp_path):
    (tmp_path / "w.csv").write_text("destination,weight,origin\nBOM,0.25,DEL\nDEL,0.75,BOM\n")
    assert sorted((r.origin, r.destination, r.pair, r.weight) for r in quotes.read_weights(spark, str(tmp_path / "w.csv")).collect()) == [("BOM", "DEL", None, 0.75), ("DEL", "BOM", None, 0.25)]
    (tmp_path / "t.csv").write_text("Year,Month,City1,City2,PaxFromCity2,PaxToCity2\n2026,5.0,DELHI,MUMBAI,10,20\n2026,x,PUNE,GOA,,1.5\n")
    rows = {r.City1: (r.City2, r.PaxToCity2, r.PaxFromCity2, r.ym) for r in benchmarks.read_traffic(spark, str(tmp_path / "t.csv")).collect()}
    assert rows == {"DELHI": ("MUMBAI", 20.0, 10.0, 202605), "PUNE": ("GOA", 1.5, None, None)}
    (tmp_path / "s.csv").write_text("b,z,a\n2,x,1\n")
    assert sinks.read_stored(spark, str(tmp_path / "s.csv"), "a int, b int, c date").rows.first()[:] == (1, 2, None)


def test_what_is_missing_is_an_error(spark, tmp_path):
    (tmp_path / "w.csv").write_text("origin,destination\nDEL,BOM\n")
    with pytest.raises(ValueError, match="weight"):
        quotes.read_weights(spark, str(tmp_path / "w.csv"))
    (tmp_path / "none").mkdir()
    for path in ("none", "nowhere"):
        with pytest.raises(ValueError):
            quotes.read_csv(spark, str(tmp_path / path))
