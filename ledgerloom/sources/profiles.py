"""Meanings of columns kept in files by fingerprint, for tables of the same columns that come later, in this process or another."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.schema import fingerprint, from_json, infer, to_json
from ledgerloom.plans.table import ColumnMeaning
from ledgerloom.sources.files import exists, publish, read_text, swap


class StoredProfiles:
    """One file for each fingerprint under a folder; the first writer's stays unless it is corrected."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.root}/{key}.profile.json"

    def known(self, key: str) -> dict[str, ColumnMeaning] | None:
        path = self._path(key)
        return from_json(json.loads(read_text(self.spark, path))) if exists(self.spark, path) else None

    def keep(self, meanings: dict[str, ColumnMeaning]) -> dict[str, ColumnMeaning]:
        """Keep what is known of columns, unless another writer was faster; returns what is kept."""
        key = fingerprint(meanings)
        if publish(self.spark, self._path(key), json.dumps(to_json(meanings), ensure_ascii=False)):
            return dict(meanings)
        return self.known(key) or dict(meanings)

    def correct(self, inferred: dict[str, ColumnMeaning], right: dict[str, ColumnMeaning]) -> dict[str, ColumnMeaning]:
        """Replace what is kept for tables whose columns are inferred as ``inferred``, in one step."""
        meanings = {c: right.get(c, m) for c, m in inferred.items()}
        swap(self.spark, self._path(fingerprint(inferred)), json.dumps(to_json(meanings), ensure_ascii=False))
        return meanings

    def of(self, df: DataFrame) -> dict[str, ColumnMeaning]:
        """The meanings of a table: those kept for its fingerprint, else inferred ones, which are then kept."""
        fresh = infer(df)
        return self.known(fingerprint(fresh)) or self.keep(fresh)
