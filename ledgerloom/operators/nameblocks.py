"""Nearest masked names by blocks: names are compared only where all but one letter agree.

Two names are close if they have the same length, the same stars and the same first letter, and differ in one other letter by few places of the
alphabet at most. So each name is listed once for each letter that may differ, with that letter left open, and within such a block by bands of
letters: a name asked for meets its own band and the two beside it, which hold all that are near enough, and no table is compared name by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ledgerloom.sources.snapshots import SnapshotStore

#: Stands for the letter that is left open; no name holds it.
OPEN = "\x00"
#: Code points that two letters may lie apart.
MOST = 180
ENTRIES = StructType([StructField("source", StringType()), StructField("kind", IntegerType()), StructField("block", StringType()), StructField("band", IntegerType()), StructField("letter", IntegerType()), StructField("name", StringType()), StructField("position", LongType())])
#: What is listed: a stored name, or the mask that stands for it.
STORED, PATTERN = 0, 1


def blocks(name: Column) -> Column:
    """``array<struct<block, letter>>``: a name with each of its letters but the first left open in turn; names without such letters are a block of their own."""
    at = F.when(F.length(name) >= 2, F.sequence(F.lit(2), F.length(name))).otherwise(F.array().cast("array<int>"))
    letters = F.filter(at, lambda i: F.substring(name, i, F.lit(1)).rlike("[가-힣]"))
    opened = F.transform(letters, lambda i: F.struct(F.concat(F.left(name, i - 1), F.lit(OPEN), F.substring(name, i + 1, F.length(name))).alias("block"), F.ascii(F.substring(name, i, F.lit(1))).alias("letter")))
    return F.when(F.size(opened) > 0, opened).otherwise(F.array(F.struct(name.alias("block"), F.lit(0).alias("letter"))))


def band(letter: Column, most: int = MOST) -> Column:
    return F.floor(letter / (most + 1)).cast("int")


def probes(queries: DataFrame, most: int = MOST) -> DataFrame:
    """``(query, block, band, asked)``: where the names of ``queries(query)`` are looked for."""
    cut = queries.where("query IS NOT NULL").select("query").distinct().select("query", F.inline(blocks(F.col("query")))).withColumnRenamed("letter", "asked")
    return cut.withColumn("band", F.explode(F.array(*(band(F.col("asked"), most) + i for i in (-1, 0, 1)))))


def nearest(queries: DataFrame, stored: DataFrame, most: int = MOST) -> DataFrame:
    """``(query, name, distance)``: for each of ``queries(query)`` the nearest of all ``stored(name)``, all ties, none beyond ``most``."""
    listed = stored.where("name IS NOT NULL").select("name").distinct().select("name", F.inline(blocks(F.col("name")))).withColumn("band", band(F.col("letter"), most))
    far = F.abs(F.col("letter") - F.col("asked"))
    near = listed.join(probes(queries, most), ["block", "band"]).where(far <= most).groupBy("query", "name").agg(F.min(far).alias("distance"))
    best = near.groupBy("query").agg(F.min("distance").alias("__best"))
    return near.join(best, "query").where(F.col("distance") == F.col("__best")).drop("__best")


class NameIndex:
    """Names of tables with the positions of their rows, kept beside them as snapshots and ordered by blocks."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, SnapshotStore(spark, root, ENTRIES)

    def put(self, alias: str, rows: DataFrame) -> int:
        """List ``rows(position, stored, pattern)`` of a table in place of what it had; null names aren't listed."""
        both = F.array(F.struct(F.lit(STORED).alias("kind"), F.col("stored").alias("name")), F.struct(F.lit(PATTERN).alias("kind"), F.col("pattern").alias("name")))
        each = rows.select("position", F.inline(both)).where("name IS NOT NULL").select("position", "kind", "name", F.inline(blocks(F.col("name"))))
        listed = each.select(F.lit(alias).alias("source"), "kind", "block", band(F.col("letter")).alias("band"), "letter", "name", "position")
        names = self.spark.createDataFrame([(alias,)], "source string")
        return self.store.publish(self.store.stage(listed.repartitionByRange("block", "band", "position").sortWithinPartitions("block", "band"), deleted=names))

    def rows_near(self, asked: list[str], most: int = MOST) -> DataFrame:
        """``(source, position)`` of all rows whose name or mask is ``most`` from one of those asked for at most. Only their blocks are read."""
        probed = probes(self.spark.createDataFrame([(a,) for a in asked], "query string"), most)
        keys = sorted({r["block"] for r in probed.select("block").collect()})
        listed = self.store.read().where(F.col("block").isin(keys))
        return listed.join(F.broadcast(probed), ["block", "band"]).where(F.abs(F.col("letter") - F.col("asked")) <= most).select("source", "position").distinct()
