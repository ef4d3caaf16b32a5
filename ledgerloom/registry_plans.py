"""Registered queries that ask questions: plans made, checked, brought into line and run over tables derived from customers, and their SQL.

Questions are made from what the tables hold (departments, months, cohorts, names), so they follow the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import analysis, questions
from ledgerloom.plans.execute import execute
from ledgerloom.plans.model import FilterCondition, QueryPlan
from ledgerloom.plans.table import TableRef
from ledgerloom.plans.validate import validate
from ledgerloom.registry_scope import donation_tables, people, scope_query

PLANNED = "question string, operation string, target string, filters string, issues int, value double"


def donations(spark: SparkSession, sf_dir: str) -> TableRef:
    return donation_tables(spark, sf_dir)["df0"]


def stored(table: TableRef, column: str, most: int) -> list[str]:
    """The first of a column's values, to ask for."""
    return [r[0] for r in table.frame.select(F.col(column).cast("string")).distinct().orderBy(column).limit(most).collect()]


def answered(spark: SparkSession, table: TableRef, asked: list[str]) -> DataFrame:
    """Each question with its plan and the value that running it gives."""
    rows = []
    for q in asked:
        plan = questions.plan(table, q)
        value = execute(plan, table).result.collect()[0][0] if plan.status == "ready" else None
        filters = ", ".join(f"{f.column} {f.operator} {f.value:g}" if isinstance(f.value, (int, float)) else f"{f.column} {f.operator} {f.value}" for f in plan.filters)
        rows.append((q, plan.operation if plan.status == "ready" else plan.status, plan.target, filters, len(validate(plan, q, {"df0": table})), None if value is None else float(value)))
    return spark.createDataFrame(rows, PLANNED).withColumn("value", F.round("value", 4))


_ROW = "SELECT {q} AS question, '{op}' AS operation, {target} AS target, {filters} AS filters, 0 AS issues, round(CAST({value} AS DOUBLE), 4) AS value FROM {source}"
_DEPARTMENTS = "(SELECT * FROM d0 WHERE dept IN (SELECT DISTINCT dept FROM d0 ORDER BY 1 LIMIT 3)) GROUP BY dept"


def by_department(name: str, words: str, op: str, target: str, value: str) -> None:
    sql = _ROW.format(q=f"concat(dept, '{words}')", op=op, target=target, filters="concat('학과 eq ', dept)", value=value, source=_DEPARTMENTS)

    @scope_query(name, sql)
    def _(spark, sf_dir):
        table = donations(spark, sf_dir)
        return answered(spark, table, [f"{d}{words}" for d in stored(table, "학과", 3)])


_AMOUNT = "'출연금액'"
by_department("planned_sums", "의 출연금액 합계는?", "sum", _AMOUNT, "sum(amount)")
by_department("planned_means", " 출연금액 평균", "mean", _AMOUNT, "avg(amount)")
by_department("planned_medians", " 출연금액의 중앙값", "median", _AMOUNT, "median(amount)")
by_department("planned_row_counts", " 기록은 몇 건이야", "count", "CAST(NULL AS VARCHAR)", "count(*)")
by_department("planned_people_counts", "는 모두 몇 명이야", "count", "CAST(NULL AS VARCHAR)", "count(DISTINCT name)")


@scope_query("planned_months", _ROW.format(q="concat('2024년 ', CAST(month(paid_on) AS VARCHAR), '월 출연금액 합계')", op="sum", target=_AMOUNT, filters="concat('출연일자 gte 2024-', lpad(CAST(month(paid_on) AS VARCHAR), 2, '0'), '-01, 출연일자 lt ', strftime(date_trunc('month', min(paid_on)) + INTERVAL 1 MONTH, '%Y-%m-%d'))", value="sum(amount)", source="d0 WHERE year(paid_on) = 2024 AND month(paid_on) IN (2, 7, 12) GROUP BY month(paid_on)"))
def _(spark, sf_dir):
    return answered(spark, donations(spark, sf_dir), [f"2024년 {m}월 출연금액 합계" for m in (2, 7, 12)])


@scope_query("planned_comparisons", _ROW.format(q="concat(CAST(w AS VARCHAR), '만원 이상 출연금액은 몇 건')", op="count", target="CAST(NULL AS VARCHAR)", filters="concat('출연금액 gte ', CAST(w * 10000 AS VARCHAR))", value="count_if(amount >= w * 10000)", source="d0, (VALUES (5), (30), (90)) t(w) GROUP BY w"))
def _(spark, sf_dir):
    return answered(spark, donations(spark, sf_dir), [f"{w}만원 이상 출연금액은 몇 건" for w in (5, 30, 90)])


@scope_query("planned_groups", "SELECT dept, round(sum(amount), 2) AS total, count(amount) AS n_rows FROM d0 GROUP BY dept")
def _(spark, sf_dir):
    table = donations(spark, sf_dir)
    plan = questions.plan(table, "학과별 출연금액 합계")
    return execute(plan, table).result.select(F.col("학과").alias("dept"), F.round("total", 2).alias("total"), "n_rows")


_CASES = [("as_planned", ""), ("made_up_value", "ungrounded"), ("number_not_asked", "ungrounded"), ("no_such_column", "unknown_column"), ("hidden_column", "hidden_column"), ("text_summed", "type"), ("other_table", "unknown_table"), ("comparison_left_out", "missing_filter"), ("top_n_not_asked", "ungrounded")]


@scope_query("checked_plans", "SELECT dept, c AS \"case\", code FROM (SELECT DISTINCT dept FROM d0), (VALUES " + ", ".join(f"('{c}', '{code}')" for c, code in _CASES) + ") t(c, code)")
def _(spark, sf_dir):
    """For each department a plan as it was made and plans with one fault each, and what the check says first."""
    tables, out = {"df0": donations(spark, sf_dir)}, []
    for dept in stored(tables["df0"], "학과", 10):
        q = f"{dept}에서 출연금액 30만원 이상 합계"
        is_dept, over = FilterCondition("학과", "eq", dept), FilterCondition("출연금액", "gte", 300_000.0, source_text="30만원 이상")
        good = QueryPlan(dataframe="df0", operation="sum", target="출연금액", filters=(is_dept, over))
        plans = {
            "as_planned": good,
            "made_up_value": good.with_(filters=(FilterCondition("학과", "eq", "철학과"), over)),
            "number_not_asked": good.with_(filters=(is_dept, FilterCondition("출연금액", "gte", 200_000.0))),
            "no_such_column": good.with_(filters=(FilterCondition("전공", "eq", dept), over)),
            "hidden_column": good.with_(filters=(FilterCondition("__pos", "gte", 300_000.0), over)),
            "text_summed": good.with_(target="학과"),
            "other_table": good.with_(dataframe="df9"),
            "comparison_left_out": good.with_(filters=(is_dept,)),
            "top_n_not_asked": good.with_(operation="group_sum", group_by=("학년",), top_n=7),
        }
        out += [(dept, name, next((i.code for i in validate(p, q, tables)), "")) for name, p in plans.items()]
    return spark.createDataFrame(out, "dept string, case string, code string")


@scope_query("aligned_values", """, made AS (SELECT DISTINCT dept FROM d0), v AS (SELECT dept, unnest([dept, concat(dept, '의'), concat(' ', dept, ' '), concat(dept[1:2], '학가'), '아무것도 아닌 말']) AS literal, unnest([dept, dept, dept, dept, '아무것도 아닌 말']) AS value FROM made)
SELECT dept, literal, value FROM v""")
def _(spark, sf_dir):
    """Literals of plans as a model may write them, and the stored values that they are taken for; those that mean none stay."""
    table, out = donations(spark, sf_dir), []
    for dept in stored(table, "학과", 10):
        literals = [dept, f"{dept}의", f" {dept} ", f"{dept[:2]}학가", "아무것도 아닌 말"]
        for literal in literals:
            plan = QueryPlan(dataframe="df0", operation="count", filters=(FilterCondition("학과", "eq", literal),))
            out.append((dept, literal, analysis.aligned(plan, f"{dept} 인원", table).filters[0].value.strip(" ")))
    return spark.createDataFrame(out, "dept string, literal string, value string")


@scope_query("absent_people", "SELECT asked, min(k) IS NULL AS absent FROM (SELECT DISTINCT concat(name[1:2], (['준','연','우','은','호','아','진','영','원','철'])[k % 10 + 1]) AS asked FROM people WHERE k <= 20) LEFT JOIN (SELECT k, name, hidden FROM d0) ON name = asked GROUP BY asked")
def _(spark, sf_dir):
    """Names made from people's, some of which nobody has, before a word for an amount."""
    endings = "준연우은호아진영원철"
    tables = {"df0": donations(spark, sf_dir)}
    made = sorted({f"{r[1][:2]}{endings[r[0] % 10]}" for r in people(spark, sf_dir).where("__pos <= 20").select("__pos", "이름").collect()})
    missing = {n for at in range(0, len(made), 10) for n in analysis.absent_people(tables, " ".join(f"{n}의 금액" for n in made[at : at + 10]))}
    return spark.createDataFrame([(n, n in missing) for n in made], "asked string, absent boolean")


@scope_query("said_of_inputs", "SELECT q, stop FROM (SELECT DISTINCT unnest([concat(dept, ' 출연금액 합계'), concat('어이 ', dept), '어이 야', 'ㅋㅋ 음', concat(dept[1], '?'), 'hello', concat(dept, ' 합계와 평균')]) AS q, unnest([NULL, NULL, 'meaningless', 'meaningless', 'meaningless', 'meaningless', 'several_operations']) AS stop FROM d0)")
def _(spark, sf_dir):
    """Inputs made from departments that are questions, and some that are none."""
    asked = {q for d in stored(donations(spark, sf_dir), "학과", 10) for q in (f"{d} 출연금액 합계", f"어이 {d}", "어이 야", "ㅋㅋ 음", f"{d[0]}?", "hello", f"{d} 합계와 평균")}
    stops = {q: analysis.analyse(q).stop for q in asked}
    return spark.createDataFrame([(q, s.code if s else None) for q, s in stops.items()], "q string, stop string")
