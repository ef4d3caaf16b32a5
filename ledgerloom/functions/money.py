"""Amounts of money written as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of amounts and column hints.
UNITS = {"원": 1, "천원": 1_000, "만원": 10_000, "억원": 100_000_000}
HINTS = {"KRW": 1, "KRW_1000": 1_000, "KRW_10000": 10_000}
GRAMMAR = r"(?i)^\s*([+-])?\s*(?:₩|KRW)?\s*(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?\s*(원|천원|만원|억원)?\s*$"


def money(c: Column, hint: str | None = None) -> Column:
    """The amount as a double; null where the whole text isn't one. A unit in the text beats the column's hint."""
    text = c.cast("string")
    parts = F.split(F.when(text.rlike(GRAMMAR), F.regexp_replace(text, GRAMMAR, "$1|$2$3|$4")), r"\|")
    number = F.regexp_replace(parts[1], ",", "").try_cast("double")
    units = F.create_map(*(F.lit(x) for unit, times in UNITS.items() for x in (unit, float(times))))
    factor = F.coalesce(F.try_element_at(units, parts[2]), F.lit(float(HINTS.get(hint or "KRW", 1))))
    return number * factor * F.when(parts[0] == "-", -1.0).otherwise(1.0)


def money_hint(header: str, unit: str | None = None) -> str | None:
    """The hint of a column: its known unit, else what its header says."""
    if unit:
        return unit
    return "KRW_10000" if "만원" in header else "KRW_1000" if "천원" in header else None
