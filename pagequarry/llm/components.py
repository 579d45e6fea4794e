"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  -> node, label: the least node that each node of an edge reaches.

    Each round takes the least label among neighbours, hands it to the node that
    was the label before as well, and then takes the label of that label, until
    nothing changes.  As labels hook onto each other, and not their nodes alone,
    rounds grow with the logarithm of a chain's length, whatever its order.  Every
    round is written to the shared folder; joins are on node keys, sums are partial
    first, and a node with very many edges is split by adaptive execution.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = written(labels.join(near, "node").select("node", F.col("label").alias("old"), "near"), "met")
        hooks = met.groupBy(F.col("old").alias("node")).agg(F.min("near").alias("hook"))
        hooked = written(met.join(hooks, "node", "left").select("node", "old", F.least("old", "near", "hook").alias("label")), "hooked")  # least skips nulls
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = hooked.join(up, "label").select("node", "old", F.least("label", "up").alias("label"))
        after = written(jumped.select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
        deleted(met, hooked, labels)
        labels = after
        if not labels.filter("moved").limit(1).count():
            deleted(both)
            return labels.select("node", "label")
