"""Connected components of an edge table, distributed: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (u, v): label is the least node that can be reached.

    Each round takes the least label among the neighbours and then the label's own label, and writes its result as a
    table, so that a lost executor costs one round at most. The work of a round is proportional to the edges; large hubs
    are only aggregated, and the joins on them are ones that Spark splits. No edges give no rows.
    """
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = both.join(labels, both["u"] == labels["node"]).groupBy("v").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["v"], "left").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        step = stored(step, "labels")
        target = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        labels = stored(step.join(target, step["label"] == target["at"]).select("node", "old", F.least("label", "further").alias("label")), "labels")
        if not labels.where("label != old").limit(1).count():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
