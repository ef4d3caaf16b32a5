"""Tables kept as Parquet with their meanings, the manifest of documents, and scopes."""

from __future__ import annotations

import json
import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.clean import strip_head_count
from ledgerloom.operators.schema import from_json, to_json
from ledgerloom.plans.table import TableRef
from ledgerloom.sources.files import exists, names_in, read_text, remove, swap

HEAD_COUNTS = ("학과", "계열", "대상학생")
TABLE = ".table.json"


def base_name(source: str) -> str:
    return unicodedata.normalize("NFC", source.replace("\\", "/").rsplit("/", 1)[-1])


class Catalog:
    """Tables under a folder of any file system Spark reaches; a snapshot is replaced in one assignment."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, TableRef] = {}

    def save(self, name: str, df: DataFrame, source: str, meanings: dict, *, label: str = "", file_hash: str = "") -> None:
        """Write the rows to a folder of their own, then swap the small file that names them: readers see the old table or the new one, whole.

        The rows before stay for those who are reading them, until the next save.
        """
        before = self._pointer(name)
        rows = f"rows-{name}-{uuid.uuid4().hex}.parquet"
        df.write.parquet(f"{self.root}/{rows}")
        meta = {"source": base_name(source), "label": label, "hash": file_hash}
        swap(self.spark, f"{self.root}/{name}{TABLE}", json.dumps({"rows": rows, "before": before.get("rows"), "meta": meta, "schema": to_json(meanings)}, ensure_ascii=False))
        if before.get("before"):
            remove(self.spark, f"{self.root}/{before['before']}")

    def _pointer(self, name: str) -> dict:
        path = f"{self.root}/{name}{TABLE}"
        return json.loads(read_text(self.spark, path)) if exists(self.spark, path) else {}

    def _names(self) -> list[str]:
        return [n.removesuffix(TABLE) for n in names_in(self.spark, self.root) if n.endswith(TABLE) and not n.startswith("_")]

    def load(self) -> dict[str, TableRef]:
        """All tables, ``df0`` onwards in the order of their names."""
        fresh = {}
        for i, name in enumerate(self._names()):
            table = self._pointer(name)
            df = self.spark.read.parquet(f"{self.root}/{table['rows']}")
            counted = [c for c in df.columns if any(h in c for h in HEAD_COUNTS) and df.schema[c].dataType.simpleString() == "string"]
            fresh[f"df{i}"] = TableRef(f"df{i}", table["meta"]["source"], strip_head_count(df, counted) if counted else df, from_json(table["schema"]), table["meta"].get("label", ""))
        self.tables = fresh
        return fresh

    def drop(self, prefix: str) -> list[str]:
        """Delete ``prefix`` and ``prefix_*``."""
        return self._delete([n for n in self._names() if n == prefix or n.startswith(prefix + "_")])

    def drop_source(self, source: str) -> list[str]:
        return self._delete([n for n in self._names() if self._pointer(n)["meta"].get("source") == base_name(source)])

    def _delete(self, names: list[str]) -> list[str]:
        for n in names:
            table = self._pointer(n)
            remove(self.spark, f"{self.root}/{n}{TABLE}")
            for rows in (table.get("rows"), table.get("before")):
                if rows:
                    remove(self.spark, f"{self.root}/{rows}")
        return names

    def scoped(self, sources: set[str] | None) -> dict[str, TableRef]:
        """Tables of selected documents; no selection means all."""
        wanted = {base_name(s) for s in sources or ()}
        return {a: t for a, t in self.tables.items() if not wanted or t.source in wanted}


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """An upsert log as a table: the last entry of each key."""
    rest = F.struct(*(c for c in log.columns if c != key))
    return log.groupBy(key).agg(F.max_by(rest, F.col(at)).alias("r")).select(key, "r.*")


def upsert(manifest: DataFrame, changes: DataFrame, key: str = "source") -> DataFrame:
    return manifest.join(changes.select(key), key, "left_anti").unionByName(changes)


def pending(files: DataFrame, manifest: DataFrame, version: str) -> DataFrame:
    """Files that aren't there yet with the same content, schema version and success."""
    done = manifest.where((F.col("status") == "SUCCESS") & (F.col("schema_version") == version)).select("source", "file_hash")
    return files.join(done, ["source", "file_hash"], "left_anti")


def replace_source(chunks: DataFrame, source: str, fresh: DataFrame) -> DataFrame:
    """The chunk table with one source's chunks replaced."""
    return chunks.where(F.col("source") != source).unionByName(fresh, allowMissingColumns=True)


def source_chunks(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.where(F.col("source") == source)


def source_counts(chunks: DataFrame) -> DataFrame:
    """How many chunks each source has."""
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"))


def delete_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.where(~F.col("source").eqNullSafe(F.lit(source)))


def content_hash(files: DataFrame) -> DataFrame:
    """``(source, file_hash)`` of a ``binaryFile`` scan."""
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("source"), F.md5("content").alias("file_hash"), "length")
