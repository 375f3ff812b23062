"""Connected components of an edge table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """edges: long columns a, b. Returns node, root: one root for each component; nodes without an edge are absent.

    In each round a node hooks onto that of its neighbours, itself included, that comes first in an order drawn anew
    for the round; edges are then drawn between the hooked-to nodes. A random order makes the count of rounds
    logarithmic. Hubs are no hot keys: minima are pre-aggregated, and each join has one row a node on one side and
    reads both sides from files, so Spark can split the other. Loops, repeated edges and nulls are harmless.
    """
    edge = C.scratch(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while True:
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("o"), F.col(c).alias("n"))
        ends = edge.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        hook = ends.groupBy("a").agg(F.min(order("b")).alias("m"))
        hook = C.scratch(hook.select(F.col("a").alias("node"), F.least("m", order("a")).getField("n").alias("to")), "hooks")
        if labels is None:
            labels = hook.select("node", F.col("to").alias("root"))
        else:
            old = labels
            moved = hook.select(F.col("node").alias("root"), "to")
            labels = C.scratch(labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            C.discard(old)
        one = edge.join(hook.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").select("a2", "b")
        both = one.join(hook.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").select("a2", "b2").where("a2 != b2")
        new = C.scratch(both.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        C.discard(edge)
        edge, turn = new, turn + 1
        if edge.isEmpty():
            return labels
