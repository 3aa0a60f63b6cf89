"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", parts: int | None = None) -> DataFrame:
    """id, component (the smallest id reachable), for every id in an edge.  Isolated ids have no row.

    Each round takes the smallest label over the neighbours and then jumps to that label's own label, so the
    number of rounds follows the logarithm of the longest path.  Lineage is cut every round; only the number of changed
    labels reaches the driver.  parts: partitions at most of what is written in a round, if the number of edges is known.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), parts)
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("new"))
        # Pointer jump: the label of the label; labels are ids and so have one themselves.
        up = labels.select(F.col("id").alias("new"), F.col("component").alias("up"))
        step = cut(step.join(up, "new", "left").select("id", "old", F.least("new", F.coalesce("up", "new")).alias("component")), parts)
        changed = step.filter("old <> component").limit(1).count()
        labels = step.select("id", "component")
        if not changed:
            return labels
