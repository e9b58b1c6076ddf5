"""Connected components of a link table, by hash-min with pointer jumping over tables in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, release

#: Rounds after which a graph that has not settled is an error; each round at least halves long chains.
ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of (a, b) links; a component is named by its smallest node.

    Each round replaces every link by links from its ends to the smaller labels; nothing is collected.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = materialize(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a")).groupBy("node").agg(F.min("component").alias("component")), "labels")
    for _ in range(ROUNDS):
        near = edges.join(labels.withColumnsRenamed({"node": "a", "component": "la"}), "a").join(labels.withColumnsRenamed({"node": "b", "component": "lb"}), "b")
        # what differs across a link: the larger label gets the smaller one as its own
        hooks = near.filter("la <> lb").select(F.greatest("la", "lb").alias("node"), F.least("la", "lb").alias("to")).groupBy("node").agg(F.min("to").alias("to"))
        hooks = materialize(hooks, "hooks")
        if hooks.isEmpty():
            release(edges, hooks)
            return labels
        jump = hooks.select(F.col("node").alias("component"), "to")
        twice = hooks.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        moved = labels.join(jump, "component", "left").join(twice, "to", "left")
        moved = materialize(moved.select("node", F.coalesce("to2", "to", "component").alias("component")), "labels")
        release(labels, hooks)
        labels = moved
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
