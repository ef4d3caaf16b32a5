"""Literals of plans against stored values, and/or by where a question writes the filters."""

from __future__ import annotations

import pytest

from ledgerloom.operators.cellindex import CellIndex
from ledgerloom.operators.scope import searched
from ledgerloom.plans import analysis
from ledgerloom.plans.model import FilterCondition, QueryPlan
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef
from ledgerloom.plans.validate import validate


@pytest.fixture
def table(spark):
    rows = [(0, "컴퓨터공학과", "Type-A", 1.0), (1, "컴퓨터교육과", "Type-B", 2.0), (2, "경영학과", "ＡＢＣ", None), (3, "경영", "", 4.0), (4, None, None, 5.0)]
    df = spark.createDataFrame(rows, f"{POSITION} long, `학과` string, `구분` string, `금액` double")
    return TableRef("df0", "t.xlsx", df, {"학과": ColumnMeaning("category", "department", "string"), "구분": ColumnMeaning("category", "field", "string"), "금액": ColumnMeaning("amount", "amount", "money", "KRW")})


SAID = [
    ("학과", "컴퓨터공학과", "x", "컴퓨터공학과"), ("학과", "컴퓨터공학과의", "x", "컴퓨터공학과"), ("학과", "경영학과생", "x", "경영학과"), ("학과", "경영대", "x", "경영"),
    ("구분", "type-a", "x", "type-a"), ("구분", "type a", "x", "Type-A"), ("구분", "abc", "x", "ＡＢＣ"), ("학과", "컴퓨터공확과", "x", "컴퓨터공학과"),
    ("학과", "컴퓨터과", "컴퓨터교육과 인원", "컴퓨터교육과"), ("학과", "컴퓨터○○과", "x", "컴퓨터○○과"), ("학과", "전혀 다른 것", "x", "전혀 다른 것"),
]


@pytest.mark.parametrize("indexed", [False, True])
def test_literals_become_stored_values(spark, table, tmp_path, indexed):
    index = None
    if indexed:
        index = CellIndex(spark, f"file://{tmp_path}/cells")
        index.put({"df0": table}, searched)
    for column, literal, question, value in SAID:
        plan = QueryPlan(dataframe="df0", operation="count", filters=(FilterCondition(column, "eq", literal),))
        assert analysis.aligned(plan, question, table, index).filters[0].value == value, literal
    part = QueryPlan(dataframe="df0", operation="count", filters=(FilterCondition("학과", "contains", "컴퓨터"),))
    assert analysis.aligned(part, "컴퓨터", table, index).filters == part.filters


def test_or_counts_where_it_stands(table):
    of = lambda question, logic="all": analysis.aligned(QueryPlan(dataframe="df0", operation="count", filter_logic=logic, filters=(FilterCondition("학과", "eq", "경영학과"), FilterCondition("구분", "eq", "Type-A"))), question, table).filter_logic
    assert of("경영학과 또는 Type-A 인원") == "any" and of("경영학과 Type-A 인원", "any") == "all"
    assert of("경영학과 Type-A 이름이거나 번호") == "all"  # an "or" that joins something else


def test_dates_of_the_question_are_grounded(table):
    from dataclasses import replace

    dated = replace(table, meanings=table.meanings | {"구분": ColumnMeaning("temporal", "date", "date")})
    of = lambda low, high, q: [i.code for i in validate(QueryPlan(dataframe="df0", operation="count", filters=(FilterCondition("구분", "gte", low), FilterCondition("구분", "lt", high))), q, {"df0": dated})]
    assert of("2024-12-01", "2025-01-01", "2024년 12월 건수") == [] and of("2024-03-01", "2024-06-01", "3월부터 5월까지 건수") == []
    assert of("2023-07-01", "2023-08-01", "2024년 12월 건수") == ["ungrounded", "ungrounded"]


def test_inputs_that_say_nothing():
    nothing = ["어이 야", "ㅋㅋ 음", "hello", "ㅎㅎ", "오케이!", "test", "야 ㅇㅇ 뭐"]
    something = ["어이 경영학과", "장학금", "hello everyone there", "abc 합계", "경영학과", "누구야"]
    assert all(map(analysis.says_nothing, nothing)) and not any(map(analysis.says_nothing, something))
