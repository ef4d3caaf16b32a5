"""Plans: their contract, their checks and their results, against plain Python."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.execute import execute, typed
from ledgerloom.plans.model import FilterCondition, PlanError, QueryPlan, SortCondition
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef
from ledgerloom.plans.validate import comparisons, validate

MEANINGS = {
    "이름": ColumnMeaning("entity", "person", "string"),
    "금액": ColumnMeaning("amount", "amount", "money", "KRW"),
    "일자": ColumnMeaning("temporal", "date", "date"),
    "기수": ColumnMeaning("category", "cohort", "number"),
}
ROWS = [
    (0, "김철수", "출연", "1,000,000", "2025-03-01", 59, None),
    (1, "이영희", "출연", "500,000", "2025-04-15", 58, "x"),
    (2, "추＊철", "기타", "2,000,000", "2025년 3월 20일", 59, ""),
    (3, "김철수", "출연", "잘못된값", "날짜오류", 60, "None"),
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(ROWS, f"{POSITION} long, `이름` string, `구분` string, `금액` string, `일자` string, `기수` int, `비고` string")
    return TableRef("df0", "a.xlsx", df.repartition(3), MEANINGS)


def run(table, **plan):
    return execute(QueryPlan(dataframe="df0", **plan), table)


def value(table, **plan):
    return run(table, **plan).result.collect()[0]["value"]


def test_values(table):
    assert value(table, operation="sum", target="금액") == 3_500_000
    assert value(table, operation="median", target="금액") == 1_000_000
    assert value(table, operation="count", distinct_by=("이름",)) == 3
    assert value(table, operation="sum", target="금액", filters=(FilterCondition("구분", "eq", "없음"),)) is None
    assert [r["value"] for r in run(table, operation="mode", target="이름").result.collect()] == ["김철수"]
    assert run(table, operation="mode", target="금액", filters=(FilterCondition("구분", "eq", "없음"),)).result.collect() == []
    e = run(table, operation="sum", target="금액", filters=(FilterCondition("구분", "eq", "출연"),)).evidence.collect()[0]
    assert (e.source_rows, e.filtered_rows, e.matched_rows, e.valid_rows, e.excluded_rows, e.unique_people) == (4, 3, 3, 2, 1, 2)


@pytest.mark.parametrize(
    ("f", "rows"),
    [
        (FilterCondition("이름", "eq", "추*철"), {2}),
        (FilterCondition("금액", "gte", "100만원"), {0, 2}),
        (FilterCondition("금액", "ne", 500000), {0, 2, 3}),
        (FilterCondition("비고", "ne", "x"), {2, 3}),
        (FilterCondition("비고", "is_null"), {0, 2, 3}),
        (FilterCondition("금액", "is_null"), {3}),
        (FilterCondition("일자", "between", ("2025-03-01", "2025-03-31")), {0, 2}),
        (FilterCondition("기수", "in", (58, 60)), {1, 3}),
        (FilterCondition("구분", "contains", "출"), {0, 1, 3}),
    ],
)
def test_filters(table, f, rows):
    assert {r[POSITION] for r in run(table, operation="list", filters=(f,)).matched.collect()} == rows


def test_nulls_come_last_both_ways(table):
    for direction in ("asc", "desc"):
        got = [r["이름"] for r in run(table, operation="list", select=("이름", "금액"), sort=(SortCondition("금액", direction),)).result.collect()]
        assert got[-1] == "김철수" and len(got) == 4


def test_ranks_and_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcde"), float(rng.randrange(6))) for i in range(200)]
    t = TableRef("df0", "s", spark.createDataFrame(rows, f"{POSITION} long, g string, v double").repartition(4), {})
    for rank in (1, 3):
        got = run(t, operation="list", sort=(SortCondition("v", "desc"),), rank_position=rank).result.collect()
        want = sorted({r[2] for r in rows})[-rank]
        assert {r["v"] for r in got} == {want} and len(got) == sum(r[2] == want for r in rows)
    assert run(t, operation="list", sort=(SortCondition("v"),), rank_position=50).result.collect() == []
    sums = {g: sum(r[2] for r in rows if r[1] == g) for g in "abcde"}
    assert {r["g"]: r["total"] for r in run(t, operation="group_sum", target="v", group_by=("g",)).result.collect()} == sums
    best = run(t, operation="group_sum", target="v", group_by=("g",), top_n=1).result.collect()
    assert {r["g"] for r in best} == {g for g, s in sums.items() if s == max(sums.values())}
    first = run(t, operation="list", distinct_by=("g",)).matched.collect()
    assert {r[POSITION] for r in first} == {min(r[0] for r in rows if r[1] == g) for g in "abcde"}
    assert run(t, operation="median", target="v").result.collect()[0]["value"] == statistics.median(r[2] for r in rows)


def test_unit_columns(spark):
    df = spark.createDataFrame([(0, "100"), (1, "25"), (2, "1만원"), (3, "미정")], f"{POSITION} long, v string")
    t = TableRef("df0", "s", df, {"v": ColumnMeaning("amount", "amount", "money", "KRW_10000")})
    assert [r[0] for r in df.select(typed(t, "v")).collect()] == [1_000_000, 250_000, 10_000, None]
    assert {r[POSITION] for r in run(t, operation="list", filters=(FilterCondition("v", "gte", 25),)).matched.collect()} == {0, 1}


@pytest.mark.parametrize(
    "bad",
    [
        {"operation": "list", "target": "a"},
        {"operation": "sum"},
        {"operation": "group_sum", "target": "a"},
        {"operation": "list", "rank_position": 2},
        {"operation": "list", "rank_position": 2, "limit": 3, "sort": (SortCondition("a"),)},
        {"operation": "max", "target": "a", "rank_position": 2},
        {"operation": "count", "limit": 3},
        {"operation": "list", "limit": 501},
        {"status": "clarification"},
        {"operation": "sum", "target": "a", "result_mode": "records"},
        {"operation": "list", "tie_policy": "dense"},
    ],
)
def test_contract(bad):
    with pytest.raises(PlanError):
        QueryPlan(**({"dataframe": "df0"} if bad.get("status") != "clarification" else {}) | bad)


def test_json_plans():
    p = QueryPlan.from_json('{"dataframe": "df0", "operation": "list", "filters": [{"column": "a", "operator": "in", "value": [1, 2]}], "sort": [{"column": "a"}], "limit": 5}')
    assert p.filters[0].value == (1, 2) and p.sort[0].direction == "asc"
    for bad in ('{"dataframe": "x", "operation": "list", "extra": 1}', '{"dataframe": "x", "operation": "list", "filters": [{"column": "a", "operator": "between", "value": [1]}]}'):
        with pytest.raises(PlanError):
            QueryPlan.from_json(bad)


def test_validation(table):
    check = lambda plan, q: {i.code for i in validate(plan, q, {"df0": table})}
    f = FilterCondition
    assert check(QueryPlan(dataframe="df0", operation="list", filters=(f("금액", "gte", "200만원"),)), "금액 200만원 이상") == set()
    assert check(QueryPlan(dataframe="df0", operation="list", filters=(f("금액", "gte", "300만원"),)), "금액 200만원 이상") == {"ungrounded"}
    assert check(QueryPlan(dataframe="df0", operation="list"), "금액 200만원 이상") == {"missing_filter"}
    assert check(QueryPlan(dataframe="df0", operation="sum", target="구분"), "구분 합계") == {"type"}
    assert check(QueryPlan(dataframe="df0", operation="sum", target=POSITION), "합계") == {"hidden_column"}
    assert check(QueryPlan(dataframe="df0", operation="list", filters=(f("구분", "eq", "없음"),)), "출연 목록") == {"ungrounded"}
    assert [(c.operator, c.value) for c in comparisons("10,000원 초과 20만원 이하 >= 5명")] == [("gt", 10000), ("lte", 200000), ("gte", 5)]
    other = TableRef("df1", "b.xlsx", table.frame, MEANINGS)
    assert "ambiguous_source" in {i.code for i in validate(QueryPlan(dataframe="df0", operation="count"), "몇 건", {"df0": table, "df1": other})}


def test_filters_reach_the_scan(spark, table, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    spark.range(100).select(F.col("id").alias(POSITION), F.col("id").cast("double").alias("v"), F.lit("x").alias("w")).write.parquet(path)
    t = TableRef("df0", "s", spark.read.parquet(path), {})
    out = run(t, operation="sum", target="v", filters=(FilterCondition("v", "gt", 50),)).result
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "w#" not in plan.split("ReadSchema")[1] and out.collect()[0]["value"] == sum(range(51, 100))


def test_tied_sums_stay_tied_in_any_order(spark):
    """0.1 + 0.2 + 0.3 isn't 0.3 + 0.2 + 0.1 in doubles; people and ranks of one total are tied all the same."""
    paid = [("가나", 0.1), ("가나", 0.2), ("가나", 0.3), ("다라", 0.3), ("다라", 0.2), ("다라", 0.1), ("마바", 0.9), ("마바", 1e-9)]
    df = spark.createDataFrame([(i, n, a) for i, (n, a) in enumerate(paid)], f"{POSITION} long, `이름` string, `금액` double").coalesce(1)
    table = TableRef("df0", "a.xlsx", df, MEANINGS)
    sums = {"operation": "group_sum", "target": "금액", "group_by": ("이름",)}
    assert {r["이름"]: r["total"] for r in run(table, **sums).result.collect()} == {"가나": 0.6, "다라": 0.6, "마바": 0.9 + 1e-9}
    assert [r["이름"] for r in run(table, top_n=1, group_order="asc", **sums).result.collect()] == ["가나", "다라"]
    assert [r["이름"] for r in run(table, rank_position=2, **sums).result.collect()] == ["가나", "다라"]
    strange = df.withColumn("금액", F.when(F.col(POSITION) == 0, float("inf")).when(F.col(POSITION) == 6, 1e25).otherwise(F.col("금액")))
    assert [r["total"] for r in run(TableRef("df0", "a.xlsx", strange, MEANINGS), **sums).result.collect()] == [float("inf"), 1e25, 0.6]
