"""Connected components of links, as joins and minima; no component and no link ever reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm.store import staged


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``), component being the smallest node reachable.

    Each round takes the smallest label among the neighbours, then the label of that label, so that long chains close in
    few rounds. Labels are written each round. Both sides of each join are read from files and shuffled for it, so the rows
    of a node with very many links are split by adaptive execution; minima are combined before they are shuffled.
    """
    pairs = links.filter("a <> b")
    edges = staged(spark, pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = staged(spark, labels.select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        lower = staged(spark, lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        moved = staged(spark, moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def reachable(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The smallest row that each row reaches over the pairs."""
    low = np.arange(count)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new
