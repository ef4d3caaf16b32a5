"""The index of cells against scans of the tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import scope
from ledgerloom.operators.cellindex import CellIndex
from ledgerloom.plans import questions
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef

TEXT = {c: ColumnMeaning("category", "field", "string") for c in ("학과", "구분")}


def table(spark, alias, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{POSITION} long, `학과` string, `구분` string, `값` double")
    return TableRef(alias, f"{alias}.xlsx", df, TEXT, alias)


@pytest.fixture
def tables(spark):
    first = [("경영학과", "신입 장학", 10.5), ("전자공학과", None, 2024.0), ("ＡＢ－１학과", "", None), ("경영", "경영 대학원", 3.0), (" 화학과 ", "가", 1.0)]
    return {"df0": table(spark, "df0", first), "df1": table(spark, "df1", [("기계과", "경영학과 부전공", 1.0)]), "df2": table(spark, "df2", [])}


QUESTIONS = ["경영학과 신입 장학금", "전자공학과를 2024년에", "없는학과 이름", "기계과와 경영학과의 부전공은", "공학", "ab1학과 경영대학원", "화학과", "가", "", "값이 10.5 이상"]


def test_questions_read_the_index_only(spark, tables, tmp_path):
    index = CellIndex(spark, f"file://{tmp_path}/cells")
    index.put(tables, scope.searched)
    for q in QUESTIONS:
        assert scope.cell_conditions(tables, q, index) == scope.cell_conditions(tables, q), q
        for t in tables.values():
            assert questions.value_filters(t, q, index) == questions.value_filters(t, q), q
    # the tables themselves are not read
    broken = F.raise_error(F.lit("read")).cast("string")
    gone = {a: TableRef(a, t.source, t.frame.withColumn("학과", broken), TEXT, a) for a, t in tables.items()}
    assert scope.cell_conditions(gone, QUESTIONS[0], index) == scope.cell_conditions(tables, QUESTIONS[0])
    assert scope.aggregation_scope(gone, QUESTIONS[0], index).notice == scope.aggregation_scope(tables, QUESTIONS[0]).notice


def test_many_words_at_once(spark, tables, tmp_path):
    index = CellIndex(spark, f"file://{tmp_path}/cells")
    index.put(tables, scope.searched)
    words = ["경영", "학과", "공학", "2024", "0.5", "없음", "ＡＢ", "대학원", " 장"]
    found = {(r["source"], r["column"], r["word"]) for r in index.holding(spark.createDataFrame([(w,) for w in [*words, "경영", "x", None]], "word string")).collect()}
    assert found == scope.scanned_cells(tables, words) == index.held(words)


def test_the_index_follows_the_tables(spark, tables, tmp_path):
    index = CellIndex(spark, f"file://{tmp_path}/cells")
    index.put(tables, scope.searched)
    index.put({"df0": table(spark, "df0", [("국문과", "x", 1.0)])}, scope.searched)
    assert index.held(["경영", "국문"]) == {("df0", "학과", "국문"), ("df1", "구분", "경영")}
    index.put({"df1": table(spark, "df1", [])}, scope.searched)  # a table that became empty leaves nothing behind
    assert index.held(["경영"]) == set()
    index.drop(["df0"])
    assert index.held(["국문"]) == set() and index.held([]) == set() == index.held(["국"])
