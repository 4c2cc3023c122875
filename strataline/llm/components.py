"""Connected components of an edge table, by minimum labels and pointer jumping, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of edges: root is the smallest node reachable. Rounds grow with the log of the diameter."""
    there = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = staged(there.unionByName(there.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = staged(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "root")
        lowest = heard.unionByName(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        moved = lowest.join(jump, "low", "left").select("node", F.least("low", "far").alias("root"))
        new = staged(moved.join(labels.withColumnRenamed("root", "old"), "node").withColumn("changed", F.col("root") != F.col("old")).select("node", "root", "changed"), "labels")
        labels = new.select("node", "root")
        if new.where("changed").isEmpty():
            return labels
