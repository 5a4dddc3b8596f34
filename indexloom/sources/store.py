"""Paths in the stores that Spark reads: the folder shared by driver and executors, and what lies at a path."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); only a local session may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    store, p = _at(spark, path)
    return store.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    store, p = _at(spark, path)
    store.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Gives what lies at a path another name, which must be free."""
    store, p = _at(spark, path)
    if exists(spark, to) or not store.rename(p, _at(spark, to)[1]):
        raise FileExistsError(to)
