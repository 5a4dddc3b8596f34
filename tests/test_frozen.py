"""Frozen baskets read back, what has drifted, and hashes that tell all rows apart."""

import pytest
from pyspark.sql import functions as F

from indexloom.functions import dimensions
from indexloom.sources import frozen, sinks


def test_frozen_files_read_back_to_the_same_root(spark, tmp_path):
    routes = dimensions.routes(spark)
    top = frozen.freeze(routes, str(tmp_path), 3)
    for kind in ("csv", "json", "yaml"):
        rows = frozen.read_frozen(spark, str(tmp_path), kind)
        assert rows.count() == 24 and frozen.check_frozen(rows) == top
        assert frozen.drifted(rows, routes).count() == 0
    text = next((tmp_path / "yaml").glob("*.txt")).read_text()
    assert text.startswith(f"version: 3\nbasket_sha256: {top}\nroutes:\n  - {{") and text.count("\n  - ") == 24
    with pytest.raises(Exception, match="exist"):
        frozen.freeze(routes, str(tmp_path), 4)
    with pytest.raises(ValueError):
        frozen.read_frozen(spark, str(tmp_path), "xml")


def test_drift_names_the_routes(spark):
    routes = dimensions.routes(spark)
    here = (F.col("origin") == "DEL") & (F.col("destination") == "BOM")
    changed = routes.where("not (origin = 'BOM' and destination = 'DEL')").withColumn("weight", F.when(here, F.col("weight") + 1e-6).otherwise(F.col("weight"))).unionByName(routes.limit(1).withColumn("origin", F.lit("GOI")))
    assert {tuple(r) for r in frozen.drifted(routes, changed).collect()} == {("DEL", "BOM", "changed"), ("BOM", "DEL", "missing"), ("GOI", "DEL", "new")}
    differing = frozen.branches(routes).exceptAll(frozen.branches(changed))
    assert {r.origin for r in differing.collect()} == {"DEL", "BOM"}
    assert frozen.drifted(routes, routes.withColumn("weight", F.col("weight") + 1e-10)).count() == 0


def test_an_altered_file_is_told(spark, tmp_path):
    frozen.freeze(dimensions.routes(spark), str(tmp_path), 1)
    rows = frozen.read_frozen(spark, str(tmp_path), "csv")
    with pytest.raises(ValueError):
        frozen.check_frozen(rows.withColumn("pax", F.when(F.col("origin") == "GAU", F.lit(1)).otherwise(F.col("pax")).cast("decimal(20,2)")))


def test_hashes_tell_rows_apart(spark):
    h = lambda *rows: sinks.content_hash(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first().sha256
    alike = [[("a|b", "c")], [("a", "b|c")], [("a", None)], [("a", "n")], [("a", "null")], [(None, "a")], [("", "a")], [("1:a", "")], [("1", ":a")], [("a", "b"), ("a", "b")], [("a", "b")]]
    assert len({h(*rows) for rows in alike}) == len(alike)
    assert h(("a", "b"), ("c", None)) == h(("c", None), ("a", "b"))
