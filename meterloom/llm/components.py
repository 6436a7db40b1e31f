"""Connected components of an edge table, by repeated contraction on the cluster.

Each round sends every node of the contracted graph to the smallest node beside it, shortens
those chains by pointer jumping until they end, and contracts the edges. At least half of the
nodes that still have edges go in each round, so rounds grow with the logarithm of the nodes.
Aggregations are partial sums of minima and joins are by node, so a node with very many edges
is split by Spark's skew join. Nothing is collected but a row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable.

    Null ends and loops are left out, repeated edges count once, no edges give no rows."""
    e = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    labels = None
    while not e.isEmpty():
        up = e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to"))
        down = e.select(F.col("u").alias("node")).distinct()
        step = cut(up.join(down, "node", "full_outer").select("node", F.coalesce("to", "node").alias("to")))
        while True:
            far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = cut(step.join(far, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            step = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = step
        else:
            labels = cut(labels.join(step.select(F.col("node").alias("to"), F.col("to").alias("last")), "to", "left").select("node", F.coalesce("last", "to").alias("to")))
        su = step.select(F.col("node").alias("u"), F.col("to").alias("u2"))
        sv = step.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        e = cut(e.join(su, "u").join(sv, "v").select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).where("u < v").distinct())
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.select("node", F.col("to").alias("component"))
