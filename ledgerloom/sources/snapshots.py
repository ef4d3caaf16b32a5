"""A table of chunks in snapshots: immutable files, a log of versions, deletes merged on read.

Each commit writes the rows of any number of sources to files of its own, and beside them which sources it replaces or deletes. A version is one small
file that lists the commits it consists of; it appears under its number by a rename that fails if the number is taken, so writers never overwrite each
other and readers see a version or the one before, never a part of one. A reader takes, for each source, the rows of the last commit that names it.
Nothing is rewritten until ``compact``, and nothing that a version of the last ones names is deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.sources.files import names_in, publish, read_text, remove

#: How often a writer takes the next number when another one was faster.
ATTEMPTS = 50


class SnapshotStore:
    """Rows with a ``source`` column under a folder of any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, source: str = "source"):
        self.spark, self.root, self.schema, self.source = spark, root.rstrip("/"), schema, source

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in names_in(self.spark, f"{self.root}/log") if n.startswith("v") and n.endswith(".json"))

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        return max(self.versions(), default=0)

    def commits(self, version: int | None = None) -> list[str]:
        """The commits of a version, first to last."""
        version = self.latest() if version is None else version
        return json.loads(read_text(self.spark, f"{self.root}/log/v{version:012d}.json"))["commits"] if version else []

    def _data(self, commit: str) -> str:
        return f"{self.root}/data/{commit}.parquet"

    def _keys(self, commit: str) -> str:
        return f"{self.root}/keys/{commit}.parquet"

    def stage(self, rows: DataFrame | None = None, deleted: DataFrame | None = None) -> str:
        """Write the files of a commit, which no version names yet. ``deleted`` holds sources; those of ``rows`` are replaced."""
        commit = uuid.uuid4().hex
        fresh = (rows if rows is not None else self.spark.createDataFrame([], self.schema)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        fresh.write.parquet(self._data(commit))
        kept = self.spark.read.schema(self.schema).parquet(self._data(commit)).select(self.source).distinct()
        gone = deleted.select(self.source).distinct() if deleted is not None else kept.limit(0)
        gone = gone.join(kept, gone[self.source].eqNullSafe(kept[self.source]), "left_anti")
        kept.withColumn("deleted", F.lit(False)).unionByName(gone.withColumn("deleted", F.lit(True))).write.parquet(self._keys(commit))
        return commit

    def publish(self, commit: str, instead_of: list[str] | None = None) -> int:
        """Make a version that ends with ``commit``; ``instead_of`` are commits that it stands for. Returns its number.

        If another writer published meanwhile the version builds on theirs: what a source holds follows the order of versions.
        """
        for _ in range(ATTEMPTS):
            before = self.latest()
            commits = self.commits(before)
            if instead_of is not None:
                if commits[: len(instead_of)] != instead_of:
                    raise RuntimeError("the commits to stand for are gone: another writer has compacted them")
                commits = [commit, *commits[len(instead_of) :]]
            else:
                commits = [*commits, commit]
            if publish(self.spark, f"{self.root}/log/v{before + 1:012d}.json", json.dumps({"commits": commits})):
                return before + 1
        raise RuntimeError(f"no version after {ATTEMPTS} attempts")

    def replace(self, rows: DataFrame) -> int:
        """All sources of ``rows`` hold these rows from the new version on."""
        return self.publish(self.stage(rows))

    def delete(self, sources: DataFrame) -> int:
        return self.publish(self.stage(deleted=sources))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default; a version read once stays as it is."""
        commits = self.commits(version)
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        numbered = self.spark.createDataFrame([(i, c) for i, c in enumerate(commits)], "__number int, __commit string")
        of = F.regexp_extract(F.input_file_name(), r"/([0-9a-f]{32})\.parquet/", 1)
        keys = self.spark.read.schema(f"`{self.source}` {self.schema[self.source].dataType.simpleString()}, deleted boolean").parquet(*map(self._keys, commits)).withColumn("__commit", of)
        last = keys.join(F.broadcast(numbered), "__commit").groupBy(self.source).agg(F.max_by(F.struct("__commit", "deleted"), "__number").alias("__last"))
        live = last.where("NOT __last.deleted").select(F.col(self.source).alias("__source"), "__last.__commit")
        rows = self.spark.read.schema(self.schema).parquet(*map(self._data, commits)).withColumn("__commit", of)
        met = (rows[self.source].eqNullSafe(live["__source"])) & (rows["__commit"] == live["__commit"])
        return rows.join(live, met, "left_semi").drop("__commit")

    def of_source(self, source, version: int | None = None) -> DataFrame:
        """Rows of one source; the filter reaches the files."""
        return self.read(version).where(F.col(self.source).eqNullSafe(F.lit(source)))

    def counts(self, version: int | None = None) -> DataFrame:
        return self.read(version).groupBy(self.source).agg(F.count(F.lit(1)).alias("n"))

    def compact(self) -> int:
        """A version with one commit for all that lives now; commits that others publish meanwhile come after it."""
        commits = self.commits()
        return self.publish(self.stage(self.read()), commits) if commits else 0

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete versions but the last ``keep``, then files that none of these names. No writer may be between ``stage`` and ``publish``."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            remove(self.spark, f"{self.root}/log/v{v:012d}.json")
        named = {c for v in versions[-keep:] for c in self.commits(v)}
        gone = sorted({n.removesuffix(".parquet") for kind in ("data", "keys") for n in names_in(self.spark, f"{self.root}/{kind}")} - named)
        for c in gone:
            remove(self.spark, self._data(c))
            remove(self.spark, self._keys(c))
        return gone
