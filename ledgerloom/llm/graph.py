"""Connected components by contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, release


def scramble(c: Column) -> Column:
    """A bijection of 64-bit integers that breaks up runs of ids (three xor-shifts).

    Contraction needs few rounds when the order of the nodes has nothing to do with the graph.
    """
    for shift, left in ((13, True), (7, False), (17, True)):
        c = c.bitwiseXOR(F.shiftleft(c, shift) if left else F.shiftrightunsigned(c, shift))
    return c


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(u, v)`` of longs.

    Each round every node points to the smallest of itself and its neighbours, and edges move to
    what their ends point to; the pointers of all rounds are then followed one after another.
    Nodes should be in no order that follows the graph (see ``scramble``). Rounds grow with the
    logarithm of the longest path; each is one aggregation with map-side combine and two joins
    that adaptive execution may split, and ends in a written table. Nothing is collected.
    """
    live = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    nodes = None
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        steps.append(to)
        moved = (
            live.join(to.select("u", F.col("p").alias("pu")), "u")
            .join(to.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            .where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct()
        )
        after = materialize(moved, "edges")
        release(live)
        live = after
    if not steps:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    nodes = steps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for to in steps[1:]:
        nodes = nodes.join(to.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return nodes
