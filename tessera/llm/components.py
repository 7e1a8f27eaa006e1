"""Connected components of an edge table by minimum labels and pointer jumping.

Every round lowers each node's label to the least label among its neighbours and then to its label's own label, so the
number of rounds grows with the logarithm of a component's diameter. Rounds are cut with tables in the shared folder.
Joins are on single keys with the labels' side unique, so a hub only lengthens the streamed side, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node id reachable. Nulls aren't nodes."""
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialize(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label"), F.lit(True).alias("changed")), "labels")
    while labels.where("changed").limit(1).count():
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        lower = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("before"), F.least("label", "least").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = lower.join(roots, "label").select("node", "before", F.least("label", "root").alias("label"))
        before, labels = labels, materialize(jumped.select("node", "label", (F.col("label") != F.col("before")).alias("changed")), "labels")
        discard(before)
    discard(both)
    return labels.select("node", F.col("label").alias("component"))
