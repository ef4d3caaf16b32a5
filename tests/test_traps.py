"""Places where plain readings of the rules go wrong, and what is decided there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import compare, schema, scope
from ledgerloom.plans.execute import execute, typed
from ledgerloom.plans.model import FilterCondition, QueryPlan
from ledgerloom.plans.results import ResultStore
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef


def test_a_null_name_stays_null(spark):
    t = TableRef("df0", "a.xlsx", spark.createDataFrame([(0, "김철수"), (1, None), (2, " nan ")], f"{POSITION} long, `이름` string"), {"이름": ColumnMeaning("entity", "person")})
    count = lambda **plan: execute(QueryPlan(dataframe="df0", operation="count", **plan), t).result.collect()[0]["value"]
    assert count(target="이름") == 2 and count(filters=(FilterCondition("이름", "is_null"),)) == 2
    assert [r[0] for r in t.frame.orderBy(POSITION).select(typed(t, "이름")).collect()] == ["김철수", None, ""]


def test_one_unit_in_the_cells_is_the_columns(spark):
    rows = [(i, "5만원" if i == 3 else str(i + 1)) for i in range(10)]
    found = schema.infer(spark.createDataFrame(rows, f"{POSITION} long, `지원금액` string"))["지원금액"]
    assert (found.data_type, found.unit, found.qualifier) == ("money", "KRW_10000", "support")


def test_numbers_with_commas_are_null_unless_money(spark):
    frame = spark.createDataFrame([(0, "1,000"), (1, "2000")], f"{POSITION} long, `수량` string")
    number = TableRef("df0", "a.xlsx", frame, {"수량": ColumnMeaning(data_type="number")})
    amount = TableRef("df0", "a.xlsx", frame, {"수량": ColumnMeaning("amount", "amount", "money", "KRW")})
    total = lambda t: execute(QueryPlan(dataframe="df0", operation="sum", target="수량"), t).result.collect()[0]["value"]
    assert total(number) == 2000 and total(amount) == 3000 and schema.infer(frame)["수량"].data_type == "number"


def test_year_amounts_take_all_rows_and_people_paid_ones(spark):
    rows = spark.createDataFrame([(0, "가", 2024, 100.0), (1, "가", 2025, -30.0), (2, "나", 2025, 0.0)], f"{POSITION} long, p string, y int, a double")
    roles = compare.Roles(F.col("p"), F.col("a"), F.col("y"))
    amounts = compare.year_amounts(rows, roles, 2024, 2025).collect()[0]
    people = compare.years_people_count(rows, roles, 2024, 2025).collect()[0]
    assert (people["first_people"], people["second_people"]) == (1, 0)
    assert (amounts["first_total"], amounts["second_total"]) == (100.0, -30.0)


def test_results_of_one_operation_have_references_of_their_own():
    store = ResultStore()
    assert store.put("rows with a filter") != store.put("rows without")


def test_rows_without_a_uid_all_stay(spark):
    a = spark.createDataFrame([(0, "x"), (1, None)], f"{POSITION} long, row_uid string")
    b = spark.createDataFrame([(0, "x"), (1, None), (2, "y")], f"{POSITION} long, row_uid string")
    assert sorted((r["row_uid"] or "") for r in scope.together([a, b]).collect()) == ["", "", "x", "y"]


def test_text_and_numbers_that_differ(spark):
    frame = spark.createDataFrame([(0, "a", 1.0), (1, None, None), (2, "b", 2.0)], f"{POSITION} long, t string, n double")
    t = TableRef("df0", "a.xlsx", frame, {})
    count = lambda f: execute(QueryPlan(dataframe="df0", operation="count", filters=(f,)), t).result.collect()[0]["value"]
    assert count(FilterCondition("t", "ne", "A")) == 1 and count(FilterCondition("n", "ne", 1)) == 2 and count(FilterCondition("t", "in", ("A", "b"))) == 1
