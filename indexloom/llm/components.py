"""Connected components of an edge table, by minimum labels and pointer jumping.

Every round halves the distance to a component's least node and is written to the shared folder, so
that neither lineage nor memory grows with the rounds. A hub with a great share of all edges only
meets joins, whose skewed sides Spark splits, and minima, which are combined before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm import textops


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the least node of its component."""
    spark = edges.sparkSession
    both, edges_path = textops.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b"), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp"))
    labels, path = textops.put(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new, new_path = textops.put(labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next")), "labels")
        jump = new.select(F.col("node").alias("next"), F.col("next").alias("far"))
        labels = new.join(jump, "next").select("node", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("changed"))
        labels, next_path = textops.put(labels, "labels")
        textops.drop(spark, path, new_path)
        path = next_path
        if not labels.where("changed").limit(1).count():
            textops.drop(spark, edges_path)
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")
