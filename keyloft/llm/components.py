"""Connected components of a link table, by repeated hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) for every vertex that has a link; root is the smallest vertex that v reaches.

    edges: columns a, b (long), in any order, repeats and self links allowed. Links stay in tables on the executors'
    side; each round at least halves the longest pointer chain, and a star or a path of any length takes a few rounds.
    """
    normal = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = scratch.save(normal(edges), "edges")
    labels = scratch.save(edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct().withColumn("root", F.col("v")), "labels")
    while not edges.isEmpty():
        hooks = scratch.save(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "hooks")
        while True:
            up = hooks.select(F.col("v").alias("u"), F.col("p").alias("pp"))
            jumped = scratch.save(hooks.join(up, hooks.p == up.u, "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jumped")
            moved = not jumped.filter("moved").isEmpty()
            scratch.drop(hooks)
            hooks = jumped
            if not moved:
                break
        relabel = lambda df, c: df.join(hooks.select(F.col("v").alias("_v"), F.col("p").alias("_p")), F.col(c) == F.col("_v"), "left").withColumn(c, F.coalesce("_p", c)).drop("_v", "_p")
        new_edges = scratch.save(normal(relabel(relabel(edges, "a"), "b")), "edges")
        new_labels = scratch.save(relabel(labels, "root"), "labels")
        for old in (edges, labels, hooks):
            scratch.drop(old)
        edges, labels = new_edges, new_labels
    return labels
