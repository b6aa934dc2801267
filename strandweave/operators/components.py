"""Connected components by contraction.

Each round hooks every node to its smallest neighbour, flattens the resulting trees by
pointer jumping and rewrites the edges between the trees' roots.  Components shrink to
one node in a logarithmic number of rounds, whatever their diameter.  All state lives in
tables in the shared folder; joins read two plain tables, so a hub with very many edges
is a skewed partition that AQE splits, and minima are pre-aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.workspace import Workspace


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node with an edge to another node.

    ``component`` is the smallest node reachable over undirected edges.  Edges with a
    null end and self-loops are ignored; repeated edges count once; no edges, no rows.
    """
    work = Workspace(edges.sparkSession, "components")
    a, b = F.col(src), F.col(dst)
    live = work.save(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels: DataFrame | None = None
    while not live.isEmpty():
        parents = _forest(live, work)
        contracted = (
            live.join(parents.toDF("a", "pa"), "a").join(parents.toDF("b", "pb"), "b")
            .where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        nxt = work.save(contracted)
        if labels is None:
            relabelled = parents.toDF("node", "component")
        else:
            relabelled = work.save(
                labels.join(parents.toDF("component", "parent"), "component", "left")
                .select("node", F.coalesce("parent", "component").alias("component"))
            )
            work.drop(labels, parents)
        work.drop(live)
        labels, live = relabelled, nxt
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _forest(edges: DataFrame, work: Workspace) -> DataFrame:
    """``(node, root)``: each node hooked to its smallest neighbour, trees flattened."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    tree = work.save(hooks)
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = work.save(
            tree.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
        )
        work.drop(tree)
        tree = jumped.select("node", "root")
        tree._workspace_path = jumped._workspace_path
        if jumped.where("moved").isEmpty():
            return tree
