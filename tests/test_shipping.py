"""A driver that runs elsewhere, without the library on its workers' path."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from indexloom.shipping import ship
from indexloom.sources.offers import json_offers
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
ship(spark)
payload = '{{"Results": [{{"AirlineCode": "SG", "FlightNumber": "123", "TotalFare": 6245, "Stops": 1}}]}}'
print(json_offers(spark.createDataFrame([(1, payload)], "doc_id long, payload string")).collect()[0].total_fare)
"""


def test_workers_get_the_library(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("6245.0") or "6245" in done.stdout, done.stderr[-2000:]
