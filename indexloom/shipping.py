"""Sends the library to the executors, which needn't see the driver's folders or have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession, beside: Iterable[Path] = ()) -> None:
    """Adds the package, and modules that lie beside it, to the Python path of the tasks; once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "indexloom.zip"  # Spark copies it from here
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted([*ROOT.glob("indexloom/**/*.py"), *beside]):
                z.write(path, path.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
