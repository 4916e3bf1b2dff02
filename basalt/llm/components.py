"""Connected components of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """id, component for every end of the links (a, b): the smallest id that links lead to.

    Each round takes the smallest label among neighbours and then the label of that label, until nothing
    changes; every round is cut off in the shared folder. Nothing is collected.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("component").alias("further"))
        fresh = materialise(step.join(jump, "m").select("id", F.least("m", "further").alias("component"), "old"), "labels")
        drop(labels)
        labels = fresh.select("id", "component")
        if fresh.where("component <> old").isEmpty():
            drop(both)
            return labels
