"""Connected components over an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that edges reach from each node.

    In every round a node takes the smallest label among its neighbours, and
    then the label of its label, so paths shrink by more than half. Each round
    is written to the shared folder. Self loops and repeated edges do no harm;
    edges with a null end are ignored. Without edges the result is empty.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    both = c.saved(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = c.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = labels.select(F.col("node").alias("mid"), F.col("label").alias("jump"))
        made = near.join(far, F.col("label") == F.col("mid")).select("node", "old", F.least("label", "jump").alias("label"))
        made = c.saved(made, "labels")
        c.release(labels)
        moved = made.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = made.select("node", "label")
        if not moved:
            c.release(both)
            return labels
