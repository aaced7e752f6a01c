"""Connected components of a graph given by its edges, for groups of near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that each one reaches.

    A node takes the smallest label around it and then the label of its label, so
    the rounds grow with the logarithm of the longest path. Every round is written
    to the shared folder; only the count of changed labels comes to the driver.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
    labels = materialize(labels, f"{name}-labels")
    while True:
        around = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        lower = materialize(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), f"{name}-labels")
        changed = lower.where("label != old").limit(1).count()
        labels = lower.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
