"""Connected components without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node of it). nodes: column node; edges: columns a, b.

    Every round each node takes the least label among itself and its neighbours
    and then the label of that label, so paths shorten by halves. State is
    written to the shared folder after every round.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("_near"))
        next_ = labels.join(near, labels.node == near.a, "left").select(
            "node", "component", F.least("component", F.coalesce("_near", "component")).alias("_least")
        )
        jump = next_.select(F.col("node").alias("_node"), F.col("_least").alias("_jump"))
        moved = cut(
            next_.join(jump, next_["_least"] == jump["_node"], "left").select("node", "component", F.least("_least", F.coalesce("_jump", "_least")).alias("_new"))
        )
        changed = not moved.where("_new <> component").isEmpty()
        labels = moved.select("node", F.col("_new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
