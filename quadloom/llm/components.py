"""Connected components by random contraction, for links too many for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import settled, spread_lookup, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, component_id), the component's smallest node; nodes without an edge aren't returned.

    Each round sends every node to that of its closed neighbourhood with the least hash, the hash being another in each
    round, and renames the edges; a constant share of the nodes goes per round whatever the shape (chains too). The first
    round goes by the node itself: edges to smallest nodes, as forests have them, are done with at once. A hub's
    edges are reduced by partial aggregation before they are shuffled and are renamed where they are, as are the nodes of
    a large component. Each round is written to the shared folder and deleted at the end. Null ends and loops are ignored.
    """
    return settled(lambda: _labelled(edges), "components")


def _labelled(edges: DataFrame) -> DataFrame:
    now = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    moves: list[DataFrame] = []
    while total := now.count():
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.xxhash64(c, F.lit(len(moves))) if moves else F.lit(0)
        key = lambda c: F.struct(order(F.col(c)).alias("h"), F.col(c).alias("n"))
        least = both.groupBy("a").agg(F.min(key("b")).alias("m"), F.count(F.lit(1)).alias("degree"))
        move = stored(least.select(F.col("a").alias("node"), F.least(F.col("m"), key("a"))["n"].alias("to"), "degree"), "move")
        moves.append(move)
        for end in ("a", "b"):
            now = spread_lookup(now, end, move, "node", "degree", total).drop(end).withColumnRenamed("to", end)
        now = stored(now.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if not moves:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    # From the last round back: where the nodes of each round are in the end.
    root = moves[-1].select("node", F.col("to").alias("root"))
    for move in reversed(moves[:-1]):
        ends = move.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        ends = ends.join(root, F.col("to") == F.col("node"), "left").select(F.col("to").alias("end"), F.coalesce("root", "to").alias("root"), "n")
        root = stored(spread_lookup(move.select("node", "to"), "to", stored(ends, "ends"), "end", "n", move.count()).select("node", "root"), "roots")
    least = stored(root.groupBy("root").agg(F.min("node").alias("component_id"), F.count(F.lit(1)).alias("n")).withColumnRenamed("root", "r"), "least")
    return spread_lookup(root, "root", least, "r", "n", root.count()).select("node", "component_id")
