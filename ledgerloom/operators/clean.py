"""Sheets as read, made into tables: headers, rows that aren't data, derived columns."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.plans.table import POSITION

# Labels of total rows.
TOTALS = ("합계", "소계", "총계", "합산", "계", "장학금계", "total", "subtotal")
AMOUNT = r"^\s*[+-]?\s*(?:₩|KRW)?\s*[\d,]+(?:\.\d+)?\s*(?:원|천원|만원)?\s*$"
LONG = 20


def column_name(text: str) -> str:
    clean = re.sub(r"\W+", "_", str(text or "").strip()).strip("_")[:40]
    return f"col_{clean}" if not clean or clean[0].isdigit() else clean


def table_name(text: str) -> str:
    clean = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()[:32]
    return clean or "t_" + hashlib.md5(text.encode()).hexdigest()[:12]


def blank(cell) -> bool:
    return cell is None or not str(cell).strip()


def header(grid: list[list]) -> tuple[list[str], int]:
    """Column names of a sheet and the row its data start at.

    The header is the first row filled to two fifths; the next row joins it if it fills half of its blanks.
    Blanks take the name to their left, repeated names get a number.
    """
    width = max((len(r) for r in grid), default=0)
    for at, row in enumerate(grid):
        cells = list(row) + [None] * (width - len(row))
        holes = [i for i, c in enumerate(cells) if blank(c)]
        if width and (width - len(holes)) / width >= 0.4:
            break
    else:
        return [], 0
    start = at + 1
    if holes and start < len(grid):
        below = list(grid[start]) + [None] * (width - len(grid[start]))
        if sum(not blank(below[i]) for i in holes) / len(holes) >= 0.5:
            cells = [f"{c} {b}".strip() if not blank(c) and not blank(b) and i not in holes else b if blank(c) else c for i, (c, b) in enumerate(zip(cells, below, strict=True))]
            start += 1
    out: list[str] = []
    seen: dict[str, int] = {}
    last = ""
    for c in cells:
        last = last if blank(c) else column_name(c)
        name = last or "col"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out, start


def _cells(columns: list[str]) -> Column:
    return F.array_compact(F.array(*(names.blank_to_null(F.col(f"`{c}`")) for c in columns)))


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def is_annotation(cells: Column) -> Column:
    """One long cell that isn't an amount, or the same long text in all cells."""
    first = F.try_element_at(cells, F.lit(1))
    single = (F.size(cells) == 1) & (F.length(first) >= LONG) & ~first.rlike(AMOUNT)
    return F.coalesce(single | ((F.size(cells) > 1) & (F.size(F.array_distinct(cells)) == 1) & (F.length(first) >= LONG)), F.lit(False))


def is_aggregate(cells: Column) -> Column:
    """A formula of head-count times amount, or a total's label beside an amount."""
    label = F.exists(cells, lambda x: F.lower(F.regexp_replace(x, r"\s", "")).isin(*TOTALS))
    return F.exists(cells, lambda x: x.rlike(r"\d+\s*명\s*[×xX*]")) | (label & F.exists(cells, lambda x: x.rlike(AMOUNT)))


def is_footer(cells: Column) -> Column:
    """At least two cells, all amounts, few distinct."""
    return (F.size(cells) >= 2) & F.forall(cells, lambda x: x.rlike(AMOUNT)) & (F.size(F.array_distinct(cells)) <= 3)


def drop_non_data(df: DataFrame) -> DataFrame:
    """Rows that hold data: no blank, annotation, total or footer rows."""
    cells = _cells(data_columns(df))
    return df.where((F.size(cells) > 0) & ~is_annotation(cells) & ~is_aggregate(cells) & ~is_footer(cells))


def drop_repeated_tail(df: DataFrame, sequence: str) -> DataFrame:
    """Trailing rows that repeat the number of the row before them go, down to the first of them."""
    last = df.agg(F.max_by(F.col(sequence), POSITION).alias("__last"))
    other = df.join(F.broadcast(last), ~F.col(sequence).eqNullSafe(F.col("__last"))).agg(F.max(POSITION).alias("__other"))
    start = df.join(F.broadcast(other), F.col(POSITION) > F.coalesce("__other", F.lit(-1))).agg(F.min(POSITION).alias("__start"))
    return df.join(F.broadcast(start), F.col(POSITION) <= F.col("__start")).drop("__start")


def strip_head_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(12명)`` behind departments goes; what is blank then is null."""
    return df.withColumns({c: names.blank_to_null(F.regexp_replace(F.col(c), r"\s*\(\s*\d+\s*명\s*\)\s*$", "")) for c in columns})


def row_uid(source: str, context: str, *parts: Column) -> Column:
    """What names a row: source, context, position, then identifier, date, cohort, department, name and amount as they are given; blank parts are skipped."""
    row = F.format_string("row_%04d", F.col(POSITION))
    return F.concat_ws("::", names.blank_to_null(F.lit(source)), names.blank_to_null(F.lit(context)), row, *(names.blank_to_null(p) for p in parts))


def identity_columns(df: DataFrame, name_column: str, source: str, context: str = "", uid_columns: tuple[str, ...] = ()) -> DataFrame:
    """Kind, name, cohort, search key and mask of the name column, and a uid of the row; originals are kept."""
    e = names.entity(F.col(name_column))
    name = e["name"]
    added = {
        "_entity_type": e["kind"],
        "_original_name": F.col(name_column),
        "_cohort": e["cohort"],
        "_search_key": names.lookup_key(name),
        "_mask_pattern": names.mask_pattern(name),
        "_is_masked": names.is_masked(name),
        "_organisation": F.when(e["kind"] == "organization", F.trim(F.col(name_column))),
        "_row_uid": row_uid(source, context, *(F.col(c) for c in uid_columns if c != name_column), F.col(name_column)),
    }
    return df.withColumns(added)


def candidate_key(mask: Column, *parts: Column) -> Column:
    """What tells people of one mask apart; null parts are skipped."""
    return names.blank_to_null(F.concat_ws("::", mask, *(names.blank_to_null(p) for p in parts)))


def expand_roster(df: DataFrame, column: str, birth_column: str | None = None) -> DataFrame:
    """One row for each ``N반 M번 이름`` of a cell, with the birth date at the same place."""
    pattern = r"(\d+)\s*반\s*(\d+)\s*번\s*([가-힣*]+)"
    entries = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
    out = df.select("*", F.posexplode(entries).alias("_entry", "_text"))
    out = out.withColumns({"class": F.regexp_extract("_text", pattern, 1).cast("int"), "seat": F.regexp_extract("_text", pattern, 2).cast("int"), "name": F.regexp_extract("_text", pattern, 3)})
    if birth_column:
        out = out.withColumn("birth", F.try_element_at(F.regexp_extract_all(F.col(birth_column), F.lit(r"\d{6,8}"), F.lit(0)), F.col("_entry") + 1))
    return out.drop("_text")


def with_system_columns(df: DataFrame, source: str, file_hash: str, table: str, fingerprint: str, version: str = "2.4") -> DataFrame:
    document = "doc_" + hashlib.sha256(f"{source}::{file_hash}".encode()).hexdigest()[:20]
    return df.withColumns(
        {
            "__schema_version": F.lit(version),
            "__document_id": F.lit(document),
            "__table_id": names.stable_id("tbl", F.lit(document), F.lit(table)),
            "__row_id": names.stable_id("row", F.lit(document), F.lit(table), F.col(POSITION)),
            "__source_file": F.lit(source),
            "__file_hash": F.lit(file_hash),
            "__mapping_fingerprint": F.lit(fingerprint),
        }
    )


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))
