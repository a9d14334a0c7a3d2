"""Connected components of a link table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the (a, b) links; a component is named by its smallest node.

    Each round every node takes the smallest label among its own and its neighbours', then the label of that label.
    Labels only fall, and the rounds end when none falls; long chains halve each round. Every round is a checkpoint.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("heard"))
        step = labels.join(heard, labels.node == heard.a).select("node", F.col("component").alias("was"), F.least("component", "heard").alias("next"))
        root = labels.select(F.col("node").alias("root"), F.col("component").alias("above"))
        step = step.join(root, step.next == root.root, "left").select("node", "was", F.least("next", F.coalesce("above", "next")).alias("component"))
        step = checkpointed(step)
        changed = step.where("component < was").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
