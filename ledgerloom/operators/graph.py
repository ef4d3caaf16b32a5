"""Groups of rows that share keys, however long the chains between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.store import discard, written


def linked_groups(members: DataFrame) -> DataFrame:
    """``(row, group)`` for ``members(row, key)``: rows that share a key, directly or through others; the smallest row names a group.

    Keys of one row are tied to its first key, and the graph of keys is contracted: each round every key points to the smallest of itself
    and its neighbours, and ties move to what their ends point to. Keys stand as digests, so their order has nothing to do with the graph and rounds grow with the
    logarithm of the longest chain. Rows take part before and after only; each round is aggregations with map-side combine and ends in a written table.
    """
    held = members.where("key IS NOT NULL").select("row", F.md5("key").alias("node")).distinct()
    first = held.groupBy("row").agg(F.min("node").alias("u"))
    live = written(held.join(first, "row").where("u <> node").select("u", F.col("node").alias("v")).distinct(), "ties")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        steps.append(to)
        moved = live.join(to.select("u", F.col("p").alias("pu")), "u").join(to.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv")
        after = written(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "ties")
        discard(live)
        live = after
    discard(live)
    placed = first.withColumnRenamed("u", "root")
    for to in steps:
        placed = placed.join(to.select(F.col("u").alias("root"), "p"), "root", "left").select("row", F.coalesce("p", "root").alias("root"))
    placed = written(placed, "rows")
    discard(*steps)
    least = placed.groupBy("root").agg(F.min("row").alias("group"))
    return placed.join(least, "root").select("row", "group")
