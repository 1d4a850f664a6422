"""Connected components of a graph held as a DataFrame of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.plans.lineage import cut


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node is connected to, over edges (a, b) of any direction.

    Every round a node takes the least label among itself and its neighbours, then the label of its label, so that long
    chains halve; it ends when nothing changes, and fails after ``rounds`` rounds rather than return half a result.
    Self loops and repeated edges are harmless; edges with a null end are left out; no edges, no rows. Neighbours' labels
    are combined before they are shuffled, so that a node with many edges gathers nowhere. Nothing comes to the driver
    but a count of changes."""
    sane = edges.select("a", "b").where("a is not null and b is not null")
    both = cut(sane.unionByName(sane.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hop = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = hop.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        new = cut(hop.join(over, hop["label"] == over["at"]).select("node", "old", F.least("label", "jump").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components not settled after {rounds} rounds")
