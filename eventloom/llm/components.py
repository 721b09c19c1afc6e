"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every id in ``links`` (a, b); the component is its smallest id.

    Each round a node takes the smallest label among its neighbours and then its label's label, so that long chains shorten by
    leaps. The state of a round is a table in the shared folder; only the number of changes reaches the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        leap = label.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = written(step.join(leap, "c").select("node", "old", F.col("further").alias("component")), "labels")
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) and further ``links`` (a, b) between any ids: components are joined, not found anew."""
    for side in ("a", "b"):
        own = found.select(F.col("node").alias(side), F.col("component").alias("_c"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
    top = components(links).select(F.col("node").alias("component"), F.col("component").alias("_top"))
    old = found.join(top, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
    new = top.select(F.col("component").alias("node"), F.col("_top").alias("component"))
    return written(old.unionByName(new.join(found.select("node"), "node", "left_anti")), "labels")
