"""Connected components by least-label propagation with pointer jumping; each round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.storage import drop, saved


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of an orderable type -> (node, label): the least node of its component, for every node of an edge.

    A round takes the least label among neighbours and then the label of that label, so long chains halve. Labels only
    ever fall within a component, and the loop ends when a round changes none. Sums are pre-aggregated per node, and the
    joins are equi-joins that adaptive execution splits where a node is hot. Tables of past rounds are deleted.
    """
    one_way = edges.where("a <> b").select("a", "b")
    both = saved(one_way.union(one_way.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = saved(least.join(target, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        drop(labels)
        labels = after
        if not changed:
            drop(both)
            return labels
