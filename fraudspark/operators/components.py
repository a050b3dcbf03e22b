"""Connected components of an edge list of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.session import cut_lineage


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an edge; the component is named by its smallest node.

    In each round every node points at the neighbour that comes first in the round's order, or at itself if none
    comes before it, and the edges move on to what their ends point at. Pointers go down in that order, so they make
    no cycles. The first round orders by the node itself, which settles stars around their smallest node at once. Every
    further round orders by a hash of its own: at least half of the nodes that still have an edge are then expected to
    point away, whatever the shape of the graph, so rounds are logarithmic and there is no limit on them. The pointers of all rounds are followed backwards at the
    end. Edges, pointers and the result are reliable checkpoints; loops and repeated edges do no harm.
    """
    nodes = edges.select(F.explode(F.array(left, right)).alias("node")).filter("node IS NOT NULL").distinct()
    active = cut_lineage(edges.filter(F.col(left) != F.col(right)).select(F.col(left).alias("a"), F.col(right).alias("b")).distinct())
    pointers = []
    while not active.isEmpty():
        mixed = len(pointers) > 0
        order = lambda c: F.struct((F.xxhash64(F.lit(len(pointers)), c) if mixed else F.lit(0)).alias("h"), c.alias("n"))  # noqa: B023, E731
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
        first = active.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.min(order(F.col("other"))).alias("first"))
        first = first.select("node", F.when(F.col("first") < order(F.col("node")), F.col("first.n")).otherwise(F.col("node")).alias("to"))
        first = cut_lineage(first)
        active = cut_lineage(
            active.join(first.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("a"), "b")
            .join(first.withColumnRenamed("node", "b"), "b").select("a", F.col("to").alias("b"))
            .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        pointers.append(first)
    roots = None
    for first in reversed(pointers):
        if roots is None:
            roots = first
            continue
        further = roots.select(F.col("node").alias("to"), F.col("to").alias("root"))
        roots = cut_lineage(first.join(further, "to", "left").select("node", F.coalesce("root", "to").alias("to")))
    if roots is None:
        return nodes.select("node", F.col("node").alias("component"))
    named = cut_lineage(nodes.join(roots, "node", "left").select("node", F.coalesce("to", "node").alias("root")))
    names = named.groupBy("root").agg(F.min("node").alias("component"))
    return named.join(names, "root").select("node", "component")
