"""Spreadsheets read without a library, recognised sheets checked, and files sent to what reads them.

A workbook is a ZIP of XML parts; only its standard parts are read. Binary files are scanned with ``binaryFile``, so each one is read in its own task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.grids import expand_ranges

#: Built-in number formats that are dates, and what marks one in a format of the workbook.
_DATE_FORMATS = {*range(14, 23), 27, 28, 29, 30, 31, 36, 45, 46, 47, 50, 57}
_DATE_MARK = re.compile(r"[ymdhs]", re.I)
IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
RECOGNITION = ("_ocr_confidence", "_ocr_low_confidence_cells", "_ocr_validation_ok", "_ocr_engine")


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _place(ref: str) -> tuple[int, int]:
    """Row and column of ``B12``, from zero."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _text(e: ET.Element) -> str:
    """Text of a string, its reading aids left out."""
    return "".join(t.text or "" for part in e if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else part) if _tag(t) == "t")


def sheets(content: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """``(name, grid)`` of every sheet, in order; cells are text, dates as yyyy-MM-dd, merged cells filled with their first cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        root = lambda part: ET.fromstring(z.read(part)) if part in names else ET.Element("none")
        shared = [_text(si) for si in root("xl/sharedStrings.xml")]
        styles = root("xl/styles.xml")
        formats = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if _tag(f) == "numFmt"}
        cells = [int(x.get("numFmtId", 0)) for xfs in styles if _tag(xfs) == "cellXfs" for x in xfs]
        dated = [n in _DATE_FORMATS or bool(_DATE_MARK.search(re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(n, "")))) for n in cells]
        targets = {r.get("Id"): r.get("Target", "") for r in root("xl/_rels/workbook.xml.rels")}
        for sheet in (s for s in root("xl/workbook.xml").iter() if _tag(s) == "sheet"):
            link = next((v for k, v in sheet.attrib.items() if k.rsplit("}", 1)[-1] == "id"), "")
            target = targets.get(link, "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            yield sheet.get("name", ""), _grid(root(part), shared, dated)


def _grid(sheet: ET.Element, shared: list[str], dated: list[bool]) -> list[list[str | None]]:
    held: dict[tuple[int, int], str] = {}
    ranges = []
    for e in sheet.iter():
        if _tag(e) == "mergeCell":
            top, _, bottom = e.get("ref", "").partition(":")
            ranges.append((*_place(top), *_place(bottom or top)))
        elif _tag(e) == "c" and e.get("r"):
            value = _cell(e, shared, dated)
            if value is not None:
                held[_place(e.get("r"))] = value
    height = max([r + 1 for r, _ in held] + [b + 1 for _, _, b, _ in ranges], default=0)
    width = max([c + 1 for _, c in held] + [r + 1 for *_, r in ranges], default=0)
    return expand_ranges([[held.get((r, c)) for c in range(width)] for r in range(height)], ranges)


def _cell(e: ET.Element, shared: list[str], dated: list[bool]) -> str | None:
    kind, style = e.get("t", "n"), int(e.get("s", 0))
    value = next((v.text for v in e if _tag(v) == "v"), None)
    if kind == "inlineStr":
        return next((_text(i) for i in e if _tag(i) == "is"), None)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind == "n" and style < len(dated) and dated[style]:
        at = pd.Timestamp("1899-12-30") + pd.to_timedelta(float(value), unit="D").round("s")
        return at.strftime("%Y-%m-%d" if at == at.normalize() else "%Y-%m-%d %H:%M:%S")
    if kind == "n":
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return value


def sheet_rows(files: DataFrame) -> DataFrame:
    """``(path, sheet, sheet_name, row, cells)`` of every row of workbooks read with ``binaryFile``."""

    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                for i, (name, grid) in enumerate(sheets(bytes(content))):
                    for at in range(0, len(grid), 10_000):
                        rows = grid[at : at + 10_000]
                        yield pd.DataFrame({"path": path, "sheet": i, "sheet_name": name, "row": range(at, at + len(rows)), "cells": rows})

    return files.select("path", "content").mapInPandas(run, "path string, sheet int, sheet_name string, row int, cells array<string>")


def recognition_quality(records: DataFrame, amounts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Recognised rows with ``_ocr_validation_ok``, and one row: rows that are empty or uncertain, and the total of the amount columns."""
    shown = [c for c in records.columns if c not in RECOGNITION and not c.startswith("_")]
    blank = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) == ""
    empty: Column = F.lit(True)
    for c in shown:
        empty = empty & blank(c)
    unsure = ~blank("_ocr_low_confidence_cells") if "_ocr_low_confidence_cells" in records.columns else F.lit(False)
    checked = records.withColumn("_ocr_validation_ok", ~(empty | unsure))
    number = lambda c: F.coalesce(F.floor(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[^0-9.\-]", "").try_cast("double")), F.lit(0))
    total = sum((F.sum(number(c)) for c in amounts), F.lit(0))
    return checked, checked.agg(F.count_if(empty).alias("empty_rows"), F.count_if(unsure).alias("uncertain_rows"), F.coalesce(total, F.lit(0)).cast("long").alias("calculated_total"))


def file_kind(path: Column) -> Column:
    """What reads a file: sheets, pages, packed, images or none."""
    end = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(end == "xlsx", "sheets").when(end == "pdf", "pages").when(end.isin("hwp", "hwpx"), "packed").when(end.isin(*IMAGES), "images").otherwise("none")


def dispatch(files: DataFrame, manifest: DataFrame, chunks: DataFrame, version: str, readers: dict[str, Callable[[DataFrame], DataFrame]], parsers: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The state of each of ``files(source, path, file_hash, content)`` and what the readers make of those to be taken in.

    A file is current if the manifest has the same content, schema version and success, as many chunks are there as it says, and they come from the
    present parser of its kind. ``manifest(source, file_hash, status, schema_version, n_chunks)``, ``chunks(source, parser_version)``.
    """
    held = chunks.groupBy("source").agg(F.count("*").alias("held"), F.min("parser_version").alias("parser"))
    named = files.withColumn("kind", file_kind(F.col("path")))
    done = manifest.where((F.col("status") == "SUCCESS") & (F.col("schema_version") == version)).select("source", F.col("file_hash").alias("known"), "n_chunks")
    wanted = F.lit(None).cast("string")
    for kind, parser in (parsers or {}).items():
        wanted = F.when(F.col("kind") == kind, parser).otherwise(wanted)
    joined = named.join(done, "source", "left").join(held, "source", "left")
    whole = F.coalesce(F.col("held"), F.lit(0)) >= F.coalesce("n_chunks", F.lit(0))
    current = F.col("known").eqNullSafe(F.col("file_hash")) & whole & (wanted.isNull() | F.col("parser").eqNullSafe(wanted))
    state = F.when(current, "current").when(F.col("kind") == "none", "unsupported").when(F.col("known").eqNullSafe(F.col("file_hash")), "again").otherwise("new")
    states = joined.withColumn("state", state)
    pending = states.where(F.col("state").isin("new", "again"))
    return states.select("source", "kind", "state"), {kind: read(pending.where(F.col("kind") == kind).select("path", "content")) for kind, read in readers.items()}
