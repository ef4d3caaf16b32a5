"""A table with the meaning of its columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

LOGICAL_TYPES = ("string", "number", "money", "date", "year_month", "boolean", "empty")
NUMERIC, ORDERED = ("number", "money"), ("number", "money", "date", "year_month")
POSITION = "__pos"


@dataclass(frozen=True)
class ColumnMeaning:
    concept: str = "unknown"
    role: str = "unknown"
    data_type: str = "string"
    unit: str | None = None
    confidence: float = 1.0
    mapping_source: str = "rule"
    qualifier: str | None = None
    sensitivity: str = "normal"
    pii_type: str | None = None
    is_derived: bool = False

    @property
    def is_person(self) -> bool:
        return self.role == "person" and self.confidence >= 0.75


@dataclass(frozen=True)
class TableRef:
    """``frame`` carries the row position ``__pos``; columns that begin with an underscore are internal."""

    alias: str
    source: str
    frame: DataFrame
    meanings: dict[str, ColumnMeaning] = field(default_factory=dict)
    label: str = ""

    def meaning(self, column: str) -> ColumnMeaning:
        if column in self.meanings:
            return self.meanings[column]
        kind = self.frame.schema[column].dataType.simpleString()
        data_type = {"timestamp": "date", "timestamp_ntz": "date", "date": "date", "boolean": "boolean", "string": "string", "void": "empty"}.get(kind, "number" if kind.startswith(("int", "bigint", "double", "float", "decimal", "small", "tiny")) else "string")
        return ColumnMeaning(data_type=data_type)

    @property
    def visible(self) -> list[str]:
        return [c for c in self.frame.columns if not c.startswith("_") and not self.meaning(c).is_derived]

    @property
    def people(self) -> list[str]:
        return [c for c in self.visible if self.meaning(c).is_person]
