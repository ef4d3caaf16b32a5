"""An inverted index of cells, kept beside the tables: which columns hold a word, without reading the tables.

Each distinct cell of a column is listed under its pairs of letters, and once under the first pair of its plain form. A word is looked up by the pair that
the fewest cells have, and what is found is held against the word; files are ordered by pairs, so a lookup reads the parts that it
needs. Tables are put in and taken out as snapshots, so a question sees all cells of a table or none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ledgerloom.plans.table import TableRef
from ledgerloom.sources.snapshots import SnapshotStore

ENTRIES = StructType([StructField(n, IntegerType() if n in ("kind", "place") else StringType()) for n in ("source", "kind", "gram", "place", "column", "value", "plain")])
#: Kinds of entries: a pair of letters of a cell, and the first pair of its plain form.
HOLDS, BEGINS = 0, 1
#: Full-width letters, digits and marks, and the plain ones that stand for them.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F))


def plain(c: Column) -> Column:
    """Letters and digits only, in lower case, full-width ones as usual ones."""
    return F.regexp_replace(F.lower(F.translate(c.cast("string"), *WIDE)), r"(?U)[\W_]", "")


def pairs(c: Column) -> Column:
    """The different pairs of neighbouring letters of a text; none for texts of one letter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def entries(table: TableRef, columns: list[str]) -> DataFrame:
    """The entries of a table: its cells are made distinct before they are cut."""
    cells = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)))
    distinct = table.frame.select(F.explode(cells).alias("x")).select("x.*").where("value <> ''").distinct().withColumn("plain", plain(F.col("value")))
    listed = F.concat(
        F.transform(pairs(F.col("value")), lambda g: F.struct(F.lit(HOLDS).alias("kind"), g.alias("gram"))),
        F.when(F.length("plain") >= 2, F.array(F.struct(F.lit(BEGINS).alias("kind"), F.left("plain", F.lit(2)).alias("gram")))).otherwise(F.array()),
    )
    return distinct.select(F.lit(table.alias).alias("source"), F.explode(listed).alias("e"), "place", "column", "value", "plain").select("source", "e.kind", "e.gram", "place", "column", "value", F.when(F.col("e.kind") == BEGINS, F.col("plain")).alias("plain"))


class CellIndex:
    """Entries of all tables under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, SnapshotStore(spark, root, ENTRIES)

    def put(self, tables: dict[str, TableRef], columns) -> int:
        """Index tables, in place of what they held before. ``columns`` gives those of a table to index."""
        rows = [entries(t, columns(t)) for t in tables.values() if columns(t)]
        names = self.spark.createDataFrame([(t.alias,) for t in tables.values()], "source string")
        if not rows:
            return self.store.delete(names)
        whole = reduce(DataFrame.unionByName, rows).repartitionByRange("kind", "gram", "value").sortWithinPartitions("kind", "gram")
        return self.store.publish(self.store.stage(whole, deleted=names))

    def drop(self, aliases: list[str]) -> int:
        return self.store.delete(self.spark.createDataFrame([(a,) for a in aliases], "source string"))

    def holding(self, words: DataFrame) -> DataFrame:
        """``(source, place, column, word)`` for each column with a cell that holds a word of ``words(word)``; words have two letters or more."""
        asked = words.where(F.length("word") >= 2).select("word").distinct()
        cut = asked.select("word", F.explode(pairs(F.col("word"))).alias("gram"))
        listed = self.store.read().where(F.col("kind") == HOLDS)
        counts = listed.join(cut.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("cells"))
        rarest = cut.join(counts, "gram", "left").groupBy("word").agg(F.min_by(F.struct("gram", "cells"), F.coalesce("cells", F.lit(0))).alias("r")).where("r.cells IS NOT NULL")
        return listed.join(rarest.select("word", "r.gram"), "gram").where(F.contains("value", F.col("word"))).select("source", "place", "column", "word").distinct()

    def held(self, words: list[str]) -> set[tuple[str, str, str]]:
        """The same as ``(source, column, word)`` for the words of one question; only their pairs are read."""
        words = [w for w in words if len(w) >= 2]
        if not words:
            return set()
        grams = sorted({w[i : i + 2] for w in words for i in range(len(w) - 1)})
        listed = self.store.read().where((F.col("kind") == HOLDS) & F.col("gram").isin(grams))
        cells = {r["gram"]: r["n"] for r in listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
        rarest = {w: min((w[i : i + 2] for i in range(len(w) - 1)), key=lambda g: cells.get(g, 0)) for w in words}
        held = [F.when((F.col("gram") == g) & F.contains("value", F.lit(w)), F.lit(w)) for w, g in rarest.items() if g in cells]
        if not held:
            return set()
        found = listed.select("source", "column", F.explode(F.array_compact(F.array(*held))).alias("word")).distinct()
        return {tuple(r) for r in found.collect()}

    def values_in(self, question: str, table: str) -> DataFrame:
        """``(column, value)`` of a table whose plain form stands in ``question``, which is plain already."""
        grams = sorted({question[i : i + 2] for i in range(len(question) - 1)})
        listed = self.store.of_source(table).where((F.col("kind") == BEGINS) & F.col("gram").isin(grams))
        return listed.where(F.contains(F.lit(question), F.col("plain"))).select("column", "value").distinct()
