"""Connected components of a graph of document ids, by contraction with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icekeel.llm._common import drop, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b: long); component is the smallest id reachable.

    Each round points every node at the smallest of itself and its neighbours, jumps pointers
    once, and contracts the edges; the number of rounds is logarithmic in the longest path.
    Hot nodes are met only in aggregations with partial sums and in joins that AQE can split.
    Self-loops are ignored except that their id is listed; an empty table gives no rows.
    """
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component")))
    live = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    while live.take(1):
        both = live.select("a", "b").union(live.select("b", "a"))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        up = least.select(F.col("v").alias("p"), F.col("p").alias("q"))
        parent = materialize(least.join(up, "p").select("v", F.col("q").alias("p")))
        relabelled = labels.join(parent, labels.component == parent.v, "left").select("id", F.coalesce("p", "component").alias("component"))
        pa, pb = parent.select(F.col("v").alias("a"), F.col("p").alias("x")), parent.select(F.col("v").alias("b"), F.col("p").alias("y"))
        contracted = live.join(pa, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        old = labels, live, parent
        labels, live = materialize(relabelled), materialize(contracted)
        for t in old:
            drop(t)
    return labels
