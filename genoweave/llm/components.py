"""Connected components of an edge table by hooking to the smallest neighbour, jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges(a, b)``; the root is the component's smallest node.

    Each round points every node at its smallest neighbour if that is smaller,
    follows pointers to the fourth, and contracts the edges onto the nodes
    reached; it ends when no edge is left. Nodes never reach the driver.
    Null ends and loops are ignored; no edges give no rows.
    """
    edges = materialize(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while True:
        both = edges.union(edges.select("b", "a"))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        pointer = materialize(smallest, "pointers")
        for _ in range(2):
            then = pointer.select(F.col("node").alias("to"), F.col("to").alias("further"))
            pointer = pointer.join(then, "to").select("node", F.col("further").alias("to"))
        pointer = materialize(pointer, "pointers")
        if roots is None:
            roots = pointer.select("node", F.col("to").alias("root"))
        else:
            then = pointer.select(F.col("node").alias("root"), F.col("to").alias("further"))
            roots = roots.join(then, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        moved_a = pointer.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        moved_b = pointer.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(moved_a, "a").join(moved_b, "b").filter("a2 <> b2")
        edges = materialize(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return roots
        roots = materialize(roots, "roots")
