"""Workbooks, recognised sheets and the dispatch of files."""

from __future__ import annotations

import io
import zipfile

from ledgerloom.sources import sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(rows: str, merges: str = "", second: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="첫째" sheetId="1" r:id="rId1"/><sheet name="둘째" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {MAIN}><si><t>이름</t></si><si><r><t>김</t></r><r><t>철수</t></r><rPh><t>x</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData>{merges}</worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData>{second}</sheetData></worksheet>")
    return out.getvalue()


ROWS = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>비고</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1000000</v></c><c r="C2"><v>1.5</v></c></row><row><c r="A3" s="1"><v>45717</v></c><c r="B3" s="2"><v>45717.5</v></c><c r="C3" s="3"><v>7</v></c><c r="D3" t="b"><v>1</v></c><c r="E3"/></row>'
MERGES = '<mergeCells><mergeCell ref="A1:B1"/></mergeCells>'


def test_cells_of_a_workbook():
    (name, grid), (other, empty) = sheets.sheets(workbook(ROWS, MERGES))
    assert (name, other, empty) == ("첫째", "둘째", [])
    assert grid == [["이름", "이름", "비고", None], ["김철수", "1000000", "1.5", None], ["2025-03-01", "2025-03-01 12:00:00", "7", "True"]]


def test_workbooks_as_rows(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook(ROWS, MERGES, '<row><c r="B2"><v>5</v></c></row>'))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.xlsx")
    rows = sorted((r["sheet"], r["row"], r["cells"]) for r in sheets.sheet_rows(files).collect())
    assert [r[:2] for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)] and rows[-1][2] == [None, "5"]


def test_recognition_quality(spark):
    df = spark.createDataFrame([("a", "1,000원", None), ("", " ", ""), ("b", "2000", "B3")], "`이름` string, `금액` string, `_ocr_low_confidence_cells` string")
    checked, quality = sheets.recognition_quality(df, ["금액"])
    assert sorted(r["_ocr_validation_ok"] for r in checked.collect()) == [False, False, True] and tuple(quality.collect()[0]) == (1, 1, 3000)
    assert tuple(sheets.recognition_quality(df.limit(0), ["금액"])[1].collect()[0]) == (0, 0, 0)


def test_dispatch(spark):
    files = spark.createDataFrame([(f"{n}", f"/x/{n}", "h", bytearray(b"c")) for n in ("new.xlsx", "same.xlsx", "changed.xlsx", "few.pdf", "old.pdf", "ok.pdf", "x.doc", "p.PNG")], "source string, path string, file_hash string, content binary")
    manifest = spark.createDataFrame([("same.xlsx", "h", "SUCCESS", "2.4", 0), ("changed.xlsx", "g", "SUCCESS", "2.4", 0), ("few.pdf", "h", "SUCCESS", "2.4", 3), ("old.pdf", "h", "SUCCESS", "2.4", 1), ("ok.pdf", "h", "SUCCESS", "2.4", 1), ("p.PNG", "h", "FAILED", "2.4", 0)], "source string, file_hash string, status string, schema_version string, n_chunks int")
    chunks = spark.createDataFrame([("few.pdf", "2"), ("old.pdf", "1"), ("ok.pdf", "2")], "source string, parser_version string")
    taken = {}
    states, out = sheets.dispatch(files, manifest, chunks, "2.4", {"sheets": lambda f: taken.setdefault("sheets", f), "pages": lambda f: f}, {"pages": "2"})
    assert {r["source"]: r["state"] for r in states.collect()} == {"new.xlsx": "new", "same.xlsx": "current", "changed.xlsx": "new", "few.pdf": "again", "old.pdf": "again", "ok.pdf": "current", "x.doc": "unsupported", "p.PNG": "new"}
    assert sorted(r["path"] for r in taken["sheets"].collect()) == ["/x/changed.xlsx", "/x/new.xlsx"] and sorted(r["path"] for r in out["pages"].collect()) == ["/x/few.pdf", "/x/old.pdf"]
