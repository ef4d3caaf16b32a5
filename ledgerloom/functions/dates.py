"""Dates written in several ways, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_timestamp(c: Column) -> Column:
    """A timestamp from text or numbers; null where nothing fits.

    Eight digits are yyyyMMdd, numbers from 20000 to 80000 are spreadsheet days since 1899-12-30; year, month and day signs, dots
    and slashes count as hyphens before the lenient reading.
    """
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    plain = F.rtrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s*[년월./]\s*", "-"), r"\s*일", " "), r"-+(\s|$)", "$1"))
    eight = F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(number).try_cast("int")).cast("timestamp")
    return F.when(text.rlike(r"^\d{8}$"), eight).when(number.between(20000, 80000), serial).otherwise(plain.try_cast("timestamp"))


def component(c: Column, suffixes: str = "년월일") -> Column:
    """The integer of a year, month or day column, its sign stripped."""
    return F.regexp_extract(F.trim(c.cast("string")), rf"^(\d+)(?:\.0+)?\s*[{suffixes}]?$", 1).try_cast("int")


def year_of(date: Column | None, year: Column | None = None) -> Column:
    parts = ([component(year)] if year is not None else []) + ([F.year(date)] if date is not None else [])
    return F.coalesce(*parts)


def month_of(date: Column | None, month: Column | None = None) -> Column:
    parts = ([component(month)] if month is not None else []) + ([F.month(date)] if date is not None else [])
    return F.coalesce(*parts)


def month_range(key_year: Column, key_month: Column, start: tuple[int | None, int], end: tuple[int | None, int]) -> Column:
    """Months from ``start`` to ``end``, both included; without years the months alone count."""
    if start[0] is None:
        return key_month.between(start[1], end[1])
    return (key_year * 100 + key_month).between(start[0] * 100 + start[1], end[0] * 100 + end[1])


def timestamp_range(c: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """The same months as a half-open range of a stored timestamp, which reaches the Parquet scan."""
    after = (end[0] + end[1] // 12, end[1] % 12 + 1)
    day = lambda y, m: F.lit(f"{y:04d}-{m:02d}-01").cast("timestamp_ntz")
    return (c >= day(*start)) & (c < day(*after))
