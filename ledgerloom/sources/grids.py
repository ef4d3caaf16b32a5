"""Grids of cells from HTML, spreadsheets and packed documents."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Tables(HTMLParser):
    """Rows of cells with their spans; tables inside tables are their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[list] = []
        self.cell: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.cell.append([])
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            if not self.open[-1]:
                self.open[-1].append([])
            span = {k: int(v) if v and v.isdigit() and 0 < int(v) < 1000 else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            self.cell[-1] = [[], span.get("rowspan", 1), span.get("colspan", 1)]

    def _close_cell(self):
        if self.cell[-1]:
            text, down, across = self.cell[-1]
            self.open[-1][-1].append((re.sub(r"\s+", " ", "".join(text)).strip(), down, across))
            self.cell[-1] = []

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr"):
            self._close_cell()
        elif self.open and tag == "table":
            self._close_cell()
            self.done.append(self.open.pop())
            self.cell.pop()

    def handle_data(self, data):
        if self.cell and self.cell[-1]:
            self.cell[-1][0].append(data)


def html_grids(page: str) -> list[list[list[str]]]:
    """Every table of a page as a rectangle; spans repeat their text."""
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    out = []
    for rows in parser.done:
        taken: dict[tuple[int, int], str] = {}
        for r, row in enumerate(rows):
            c = 0
            for text, down, across in row:
                while (r, c) in taken:
                    c += 1
                for i in range(min(down, len(rows) - r)):
                    for j in range(across):
                        taken.setdefault((r + i, c + j), text)
                c += across
        width = max((c for _, c in taken), default=-1) + 1
        out.append([[taken.get((r, c), "") for c in range(width)] for r in range(len(rows))])
    return out


def expand_ranges(grid: list[list], ranges: list[tuple[int, int, int, int]]) -> list[list]:
    """Merged cells ``(top, left, bottom, right)`` filled with their first cell; nothing else is filled."""
    out = [list(r) for r in grid]
    for top, left, bottom, right in ranges:
        for r in range(top, min(bottom + 1, len(out))):
            for c in range(left, min(right + 1, len(out[r]))):
                out[r][c] = grid[top][left]
    return out


def expand_spans(grid: list[list], tops: list[list[float | None]], bottoms: list[list[float | None]]) -> list[list]:
    """A missing cell takes the text above only where that cell's box reaches over the row."""
    out = [list(r) for r in grid]
    for r in range(1, len(out)):
        for c in range(len(out[r])):
            if out[r][c] is None and out[r - 1][c] is not None and bottoms[r - 1][c] is not None:
                edge = max((b for b in bottoms[r] if b is not None), default=None)
                if edge is not None and bottoms[r - 1][c] >= edge - 1:
                    out[r][c], bottoms[r][c], tops[r][c] = out[r - 1][c], bottoms[r - 1][c], tops[r - 1][c]
    return out


def hwpx_text(content: bytes) -> str:
    """Paragraphs of a packed document's sections."""
    lines = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if re.search(r"section\d*\.xml$", n)):
            for p in ET.fromstring(z.read(name)).iter():
                if p.tag.endswith("}p") or p.tag == "p":
                    text = "".join(t.text or "" for t in p.iter() if t.tag.endswith("}t") or t.tag == "t")
                    if text.strip():
                        lines.append(text)
    return "\n".join(lines)


def page_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, table, row, cells)`` of every table row."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = [(k, t, r, cells) for k, page in zip(f[key], f[html], strict=True) for t, grid in enumerate(html_grids(page)) for r, cells in enumerate(grid)]
            yield pd.DataFrame(rows, columns=["key", "table_index", "row_index", "cells"])

    return pages.select(key, html).mapInPandas(run, f"key {kind}, table_index int, row_index int, cells array<string>").withColumnRenamed("key", key)


def packed_texts(files: DataFrame) -> DataFrame:
    """Text of packed documents read with ``binaryFile``."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [hwpx_text(bytes(c)) for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
