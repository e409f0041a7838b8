"""Connected components as DataFrame joins: distributed union-find by rounds of hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.runtime import checkpoint


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Each round hooks every node to its smallest neighbour, jumps pointers until all point at a
    root, and contracts the edges to roots. A round at least halves the nodes that still have
    edges, so the rounds are logarithmic. Joins are on node ids with no operator above that needs
    a key's rows together, so adaptive execution can split a node with very many links; the
    minima are pre-aggregated before they are shuffled. Null ends and loops are left out; with no
    edges the result is empty.
    """
    live = checkpoint(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v"))
    found = None
    while True:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = checkpoint(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("root")))
        while True:
            up = roots.select(F.col("u").alias("root"), F.col("root").alias("above"))
            jumped = checkpoint(roots.join(up, "root").select("u", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")))
            still = bool(jumped.where("moved").take(1))
            roots = jumped.drop("moved")
            if not still:
                break
        if found is None:
            found = roots
        else:
            step = roots.select(F.col("u").alias("root"), F.col("root").alias("above"))
            found = checkpoint(found.join(step, "root", "left").select("u", F.coalesce("above", "root").alias("root")))
        a = roots.select("u", F.col("root").alias("a"))
        b = roots.select(F.col("u").alias("v"), F.col("root").alias("b"))
        live = checkpoint(live.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if not live.take(1):
            return found.select(F.col("u").alias("node"), F.col("root").alias("component"))
