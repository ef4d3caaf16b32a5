"""Readers of pages, packed documents and images, with tools that stand in for installed ones."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerloom.operators import retrieval
from ledgerloom.sources import binaries


class Table:
    bbox = (0, 0, 1, 1)

    def __init__(self, grid, boxes):
        self.grid, self.rows = grid, [type("Row", (), {"cells": b}) for b in boxes]

    def extract(self):
        return [list(r) for r in self.grid]


class Page:
    def __init__(self, text, tables=()):
        self.text, self.tables = text, list(tables)

    def find_tables(self):
        return self.tables

    def outside_bbox(self, box):
        return self

    def extract_text(self):
        return self.text


def document(_):
    spanned = Table([["a", "b"], [None, "c"]], [[(0, 0, 5, 20), (5, 0, 9, 10)], [None, (5, 10, 9, 20)]])
    loose = Table([["a", "b"], [None, "c"]], [[(0, 0, 5, 10), (5, 0, 9, 10)], [None, (5, 10, 9, 20)]])
    return type("Pdf", (), {"pages": [Page("첫째 쪽의 본문입니다"), Page("둘째 쪽의 본문입니다", [spanned, loose]), Page("")]})


def parts(content):
    return binaries.pdf_parts(content, document, lambda page: "읽은 글")


def test_pages_tables_and_blank_pages(spark):
    found = list(parts(b""))
    assert [(p, k, t) for p, k, t, _ in found] == [(1, "text", "첫째 쪽의 본문입니다"), (2, "text", "둘째 쪽의 본문입니다"), (2, "table", ""), (2, "table", ""), (3, "text", "읽은 글")]
    assert found[2][3] == [["a", "b"], ["a", "c"]] and found[3][3] == [["a", "b"], [None, "c"]]
    rows = binaries.pages(spark.createDataFrame([("/a.pdf", bytearray(b"x"))], "path string, content binary"), lambda c: iter([(1, "text", "글", []), (1, "table", "", [["a", None], ["b", "c"]])])).collect()
    assert [(r["page"], r["kind"], r["cells"]) for r in rows] == [(1, "text", None), (1, "table", ["a", None]), (1, "table", ["b", "c"])]


def test_missing_tools_are_named():
    with pytest.raises(RuntimeError, match="no_such_module"):
        binaries.tool("no_such_module")
    with pytest.raises(RuntimeError, match="no_such_program"):
        binaries.converted(b"", ["no_such_program"], ".hwp")
    assert binaries.converted(b"some text", ["cat"], ".hwp") == "some text"


def test_tables_of_converted_documents():
    page = "<table><tr><td>1<td>개요</tr></table><table><tr><td>가<td>나</tr><tr><td>1<td>2</tr></table><table><tr><td>2.<td>일정</tr></table><table><tr><td>다</tr><tr><td>라</tr></table>"
    assert binaries.hwp_tables(page) == [("1 개요", [["가", "나"], ["1", "2"]]), ("2. 일정", [["다"], ["라"]])]


def test_records_of_an_image():
    ink = np.zeros((61, 91), bool)
    ink[[0, 20, 40, 60], :] = True
    ink[:, [0, 30, 60, 90]] = True
    ink[41:60, 30] = False  # the last row's first two cells are one
    assert binaries.grid_lines(ink) == ([0, 20, 40, 60], [0, 30, 60, 90])
    words = iter([("이름", 99.0), ("", 99.0), ("금액", 99.0), ("김", 90.0), ("x", 40.0), ("5", 80.0), ("합계", 95.0), ("7", 95.0)])
    assert binaries.image_records(ink, lambda box: next(words)) == [
        {"이름": "김", "col_1": "x", "금액": "5", "_ocr_confidence": 40.0, "_ocr_low_confidence_cells": "col_1"},
        {"이름": "합계", "col_1": "합계", "금액": "7", "_ocr_confidence": 95.0, "_ocr_low_confidence_cells": ""},
    ]
    assert binaries.image_records(np.zeros((5, 5), bool), lambda box: ("", 0)) == []


def test_chunks_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found: dict[int, list[str]] = {}
    for r in retrieval.split_chunks(docs).orderBy("doc_id", "chunk").collect():
        found.setdefault(r["doc_id"], []).append(r["text"])
    for r in docs.collect():
        text, at, end = r["text"] or "", 0, 0
        for chunk in found.get(r["doc_id"], []):
            assert 20 <= len(chunk) <= 500
            at = text.index(chunk, max(at, end - 100))  # chunks are stretches of the text, in order, that share at most 100 letters
            assert len(text[end:at].strip()) < 20
            at, end = at + 1, at + len(chunk)
        assert len(text[end:].strip()) < 20
