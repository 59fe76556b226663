"""Connected components of a graph given by links, for graphs of any size.

Minimum labels travel along the links, and each round then takes its label's own label, so distances halve.
Every round is written to the shared folder; only the number of nodes that still change comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of links (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.save(both, "links")
    label = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"))
    label = saved = scratch.save(label, "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        least = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = scratch.save(least.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")), "labels")
        changed = new.filter("component <> old").limit(1).count()
        scratch.drop(saved)
        saved, label = new, new.select("node", "component")
        if not changed:
            scratch.drop(both)
            return label
