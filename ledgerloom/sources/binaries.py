"""Pages, packed documents and images read by tools that may be installed beside the engine.

Each reader takes files of a ``binaryFile`` scan and runs its tool in the task that holds the file. The tool is looked for on the executor, or handed
in; without it the reader says what is missing. What the tools give is put into the engine's own shapes here.
"""

from __future__ import annotations

import importlib
import io
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.sources.grids import expand_spans, html_grids

#: Pages with fewer letters than this are read as images, and cells below this confidence are marked.
BLANK, SURE, DOTS = 10, 60.0, 300
#: Seconds after which a converter is given up.
PATIENCE = 120


def tool(name: str):
    """An installed module, or an error that says what to install."""
    try:
        return importlib.import_module(name)
    except ImportError as missing:
        raise RuntimeError(f"reading these files needs the module {name} on the executors, or a reader of your own") from missing


def pdf_parts(content: bytes, open_pdf: Callable | None = None, recognise: Callable[[object], str] | None = None) -> Iterator[tuple[int, str, str, list]]:
    """``(page, kind, text, grid)`` of a document: the text of each page outside its tables, then its tables with confirmed spans filled.

    ``open_pdf`` gives pages with ``find_tables``, ``outside_bbox`` and ``extract_text``. Pages without text go to ``recognise``.
    """
    opened = (open_pdf or tool("pdfplumber").open)(io.BytesIO(content))
    for number, page in enumerate(opened.pages, 1):
        tables = page.find_tables()
        rest = page
        for t in tables:
            rest = rest.outside_bbox(t.bbox)
        text = rest.extract_text() or ""
        if len(text.strip()) < BLANK and not tables and recognise is not None:
            text = recognise(page)
        yield number, "text", text, []
        for t in tables:
            boxes = [[c for c in row.cells] for row in t.rows]
            tops, bottoms = ([[None if c is None else c[k] for c in row] for row in boxes] for k in (1, 3))
            yield number, "table", "", expand_spans(t.extract(), tops, bottoms)


def recognised_page(page) -> str:
    """The text of a page as an image, in Korean and English."""
    return tool("pytesseract").image_to_string(page.to_image(resolution=DOTS).original, lang="kor+eng")


def converted(content: bytes, command: list[str], ending: str) -> str:
    """What a converter prints for a file."""
    if shutil.which(command[0]) is None:
        raise RuntimeError(f"reading these files needs the program {command[0]} on the executors")
    with tempfile.NamedTemporaryFile(suffix=ending) as f:  # read and deleted within the task
        f.write(content)
        f.flush()
        return subprocess.run([*command, f.name], capture_output=True, timeout=PATIENCE, check=True, env=os.environ | {"PYTHONIOENCODING": "utf-8"}).stdout.decode("utf-8", "replace")


def hwp_text(content: bytes) -> str:
    return converted(content, ["hwp5txt"], ".hwp")


def hwp_tables(page: str) -> list[tuple[str, list[list[str]]]]:
    """``(section title, grid)`` of the tables of a converted document; a table of one row with a number before its words is a title for those after it."""
    title, out = "", []
    for grid in html_grids(page):
        cells = [c for row in grid for c in row if c.strip()]
        if len(grid) == 1 and 1 < len(cells) <= 3 and cells[0].strip().rstrip(".").isdigit():
            title = " ".join(c.strip() for c in cells)
        elif grid:
            out.append((title, grid))
    return out


def grid_lines(ink, least: float = 0.5) -> tuple[list[int], list[int]]:
    """Rows and columns of an image array of dark pixels in which at least a share is dark, runs of neighbours as one: the lines of a table."""
    import numpy as np

    def middles(dark: np.ndarray) -> list[int]:
        at = np.flatnonzero(dark)
        return [int(run[len(run) // 2]) for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(run)]

    ink = np.asarray(ink, bool)
    return middles(ink.mean(1) >= least), middles(ink.mean(0) >= least)


def image_records(ink, cell_text: Callable[[tuple[int, int, int, int]], tuple[str, float]], border: float = 0.5) -> list[dict]:
    """Records of a table in an image: the first row names the columns, cells without a border between them are one.

    ``cell_text`` reads a box ``(top, left, bottom, right)`` and says how sure it is. Records carry their least confidence and the names of unsure cells.
    """
    import numpy as np

    ink = np.asarray(ink, bool)
    ys, xs = grid_lines(ink)
    grid: list[list[tuple[str, float]]] = []
    for r in range(len(ys) - 1):
        row: list[tuple[str, float]] = []
        for c in range(len(xs) - 1):
            top, bottom, left, right = ys[r] + 1, ys[r + 1], xs[c] + 1, xs[c + 1]
            open_left = c > 0 and ink[top:bottom, xs[c]].mean() < border
            open_above = r > 0 and ink[ys[r], left:right].mean() < border
            row.append(row[-1] if open_left else grid[-1][c] if open_above else cell_text((top, left, bottom, right)))
        grid.append(row)
    if len(grid) < 2:
        return []
    names = [text.strip() or f"col_{i}" for i, (text, _) in enumerate(grid[0])]
    out = []
    for row in grid[1:]:
        unsure = [n for n, (_, sure) in zip(names, row, strict=True) if sure < SURE]
        out.append({n: text for n, (text, _) in zip(names, row, strict=True)} | {"_ocr_confidence": min(sure for _, sure in row), "_ocr_low_confidence_cells": ",".join(unsure)})
    return out


def pages(files: DataFrame, parts: Callable[[bytes], Iterator[tuple[int, str, str, list]]] = pdf_parts) -> DataFrame:
    """``(path, page, kind, text, cells)`` of documents: a row for each page's text and for each row of its tables."""

    def run(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows = [(path, page, kind, text, cells) for page, kind, text, grid in parts(bytes(content)) for cells in (grid or [None])]
                yield pd.DataFrame(rows, columns=["path", "page", "kind", "text", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, kind string, text string, cells array<string>")


def texts(files: DataFrame, read: Callable[[bytes], str] = hwp_text) -> DataFrame:
    """``(path, text)`` of packed documents."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [read(bytes(c)) for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
