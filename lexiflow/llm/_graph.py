"""Connected components of an edge table, as joins over a graph that shrinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component), written, of every node of ``edges`` (columns a, b: long); the component is its least node.

    Each round every node takes the least label among itself and its neighbours, then that one's label; nodes of one
    label become one, and only edges between labels go on. Only a minimum per node crosses a shuffle, so a node with
    very many edges is summed before. Each round's tables are written to the shared folder, so no lineage grows and
    lost executors cost one round at most.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    held = None
    while True:
        both = edges.union(edges.select("b", "a"))
        hooked = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("low")), "cc-hooked")
        jump = hooked.select(F.col("node").alias("at"), F.col("low").alias("further"))
        labels = materialize(hooked.join(jump, hooked.low == jump["at"]).select("node", F.least("low", "further").alias("label")), "cc-labels")
        new = labels.select(F.col("node").alias("component"), F.col("label").alias("to"))
        known = labels.withColumnRenamed("label", "component") if held is None else held.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        known = materialize(known, "cc-known")
        x, y = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        left = edges.join(x, "a").join(y, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        left = materialize(left, "cc-edges")
        discard(edges, hooked, labels, *([held] if held is not None else []))
        held, edges = known, left
        if edges.isEmpty():
            discard(edges)
            return held
