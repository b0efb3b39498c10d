"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabriloom.llm.common import discard, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being the least node reachable.

    Each round gives every node the least label of its neighbours and then of the node that its label names, so
    paths shrink geometrically. Labels are written to the shared folder each round; only a count of changes
    comes back. Least labels are combined before the shuffle, so a node with very many links is no hot task."""
    both = stage(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        mine = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = stage(mine.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = after.where("label <> old").limit(1).count()
        discard(labels)
        labels = after
        if not changed:
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
