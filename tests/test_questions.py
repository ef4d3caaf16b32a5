"""Questions and the plans they become."""

from __future__ import annotations

import pytest

from ledgerloom.plans.execute import execute
from ledgerloom.plans.questions import Clarification, guard, intents, log_metadata, month_range, person_suggestions, plan, rank_position, route, suggestions, top_n
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef
from ledgerloom.plans.validate import validate


@pytest.fixture(scope="module")
def table(spark):
    rows = [(0, "김철수", "경영학과", "1,000,000", "2025-03-01", 59), (1, "이영희", "컴퓨터학과", "500,000", "2025-04-15", 58), (2, "추＊철", "경영학과", "2,000,000", "2025-03-20", 59), (3, "김철수", "경영학과", "300,000", "2024-03-02", 59)]
    df = spark.createDataFrame(rows, f"{POSITION} long, `이름` string, `학과` string, `출연금액` string, `출연일자` string, `기수` int")
    meanings = {"이름": ColumnMeaning("entity", "person"), "학과": ColumnMeaning("category", "department"), "출연금액": ColumnMeaning("amount", "amount", "money", "KRW"), "출연일자": ColumnMeaning("temporal", "date", "date"), "기수": ColumnMeaning("category", "cohort", "number")}
    return TableRef("df0", "a.xlsx", df, meanings)


@pytest.mark.parametrize(
    ("question", "operations"),
    [("출연금액 합계는?", ["sum"]), ("총 몇 명이야?", ["count"]), ("금액 중앙값", ["median"]), ("1인당 평균 금액", ["per_capita"]), ("평균 출연금액", ["mean"]), ("가장 많이 낸 사람", ["max"]), ("가장 적은 금액", ["min"]), ("명단 보여줘", [])],
)
def test_intents(question, operations):
    assert [i.operation for i in intents(question)] == operations


def test_words():
    assert (top_n("상위 5명"), rank_position("두 번째로 큰"), rank_position("3위"), rank_position("전체")) == (5, 2, 3, None)
    assert month_range("2025년 3월부터 5월까지").end == (2025, 5) and month_range("3월").start == (None, 3) and month_range("없음") is None
    assert isinstance(month_range("5월부터 3월까지"), Clarification) and isinstance(month_range("13월"), Clarification)
    assert [guard(q).code for q in ("", "ㅋ", "ㅋㅋㅋㅋ", "알려줘", "평균과 합계")] == ["empty", "meaningless", "meaningless", "vague", "several_operations"]
    assert [route(q) for q in ("문서 목록 보여줘", "합계는?", "신청 절차 설명", "명단 조회")] == ["documents", "table", "text", "table"]
    assert log_metadata("x")["length"] == 1


def answer(table, question):
    p = plan(table, question)
    assert p.status == "ready", p.message
    return p, execute(p, table).result.collect()


def test_plans(table):
    assert answer(table, "출연금액 합계는?")[1][0]["value"] == 3_800_000
    assert answer(table, "몇 명이야?")[1][0]["value"] == 3
    assert answer(table, "2025년 3월 출연금액 합계")[1][0]["value"] == 3_000_000
    assert answer(table, "출연금액 50만원 이상 몇 건이야?")[1][0]["value"] == 3
    p, rows = answer(table, "김철수 출연금액 합계")
    assert p.result_mode == "person_totals" and sum(r["total"] for r in rows) == 1_300_000
    assert [r["이름"] for r in answer(table, "출연금액이 가장 많은 사람")[1]] == ["추*철"]
    assert {r["학과"]: r["total"] for r in answer(table, "학과별 출연금액 합계")[1]} == {"경영학과": 3_300_000, "컴퓨터학과": 500_000}
    assert len(answer(table, "경영학과 목록 보여줘")[1]) == 3
    assert {r["출연금액"] for r in answer(table, "두 번째로 큰 출연금액 목록")[1]} == {"1,000,000"}
    assert len(answer(table, "58기 명단 보여줘")[1]) == 1
    for q in ("3월 합계", "5월부터 3월까지 합계", "평균과 합계"):
        assert plan(table, q).status == "clarification"


def test_plans_pass_validation(table):
    for q in ("출연금액 합계는?", "출연금액 50만원 이상 몇 건이야?", "경영학과 목록 보여줘"):
        assert validate(plan(table, q), q, {"df0": table}) == []


def test_suggestions(table):
    assert person_suggestions(table, "김철") == ["김철수"] and person_suggestions(table, "추영") == ["추*철"] and person_suggestions(table, "김") == []
    assert "출연금액 합계" in suggestions(table) and suggestions(table, "학과별") == ["학과별 출연금액 합계"]
