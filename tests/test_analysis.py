"""What questions ask for, decisions, and plans brought into line; several tables at once."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import answers, schema, scope, sections
from ledgerloom.plans import analysis
from ledgerloom.plans.execute import exact_median, execute
from ledgerloom.plans.model import FilterCondition, QueryPlan, SortCondition
from ledgerloom.plans.questions import plan, plan_dated
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef
from ledgerloom.plans.validate import validate

MEANINGS = {"이름": ColumnMeaning("entity", "person"), "학과": ColumnMeaning("category", "department"), "출연금액": ColumnMeaning("amount", "amount", "money", "KRW"), "출연일자": ColumnMeaning("temporal", "date", "date"), "연락처": ColumnMeaning("contact", "phone", pii_type="phone", sensitivity="sensitive")}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(0, "김철수", "경영학과", "1,000,000", "2025-03-01", "010-1"), (1, "이영희", "컴퓨터학과", "500,000", "2025-04-15", None), (2, "추＊철", "경영학과", "2,000,000", "2025-03-20", ""), (3, "김철수", "경영학과", "300,000", "2024-03-02", "010-1")]
    return TableRef("df0", "2025_기부.xlsx", spark.createDataFrame(rows, f"{POSITION} long, `이름` string, `학과` string, `출연금액` string, `출연일자` string, `연락처` string"), MEANINGS, "기부대장")


@pytest.mark.parametrize(
    ("question", "operations", "engine"),
    [("출연금액 합계", ("sum_amount",), "table"), ("가장 많이 낸 사람", ("max_person_by_amount",), "table"), ("2024년과 2025년 비교", ("compare",), "table"), ("어떤 문서가 있어", ("list_documents",), "documents"), ("신청 절차 설명해줘", ("document_procedure", "document_explain"), "text"), ("3월", ("filter_records",), "table"), ("합계와 신청 방법", ("sum_amount", "document_procedure"), "guide"), ("안녕하세요 반가워요", (), "text")],
)
def test_operations_and_routes(question, operations, engine):
    found = analysis.analyse(question)
    assert found.operations == operations and analysis.route_of(found) == engine


def test_decisions():
    good = {"status": "ready", "reason": "r", "requests": [{"source_text": "합계", "operation": "sum_amount"}]}
    assert analysis.Decision.from_json(json.dumps(good)).operations == ("sum_amount",)
    for change in ({"reason": ""}, {"status": "odd"}, {"operations": ["x"]}, {"retrieval_query": "q"}, {"message": "m"}, {"extra": 1}, {"operations": ["sum_amount", "compare"]}, {"status": "clarification", "message": "m"}):
        with pytest.raises(analysis.DecisionError):
            analysis.Decision.from_json(good | change)
    answers_ = iter(["{}", json.dumps(good)])
    seen = []
    assert analysis.decide("합계는?", lambda p: seen.append(p) or next(answers_)).operations == ("sum_amount",) and "오류" in seen[1]
    assert analysis.decide("출연금액 합계는?", lambda p: "no json").operations == ("sum_amount",)
    assert analysis.decide("").status == "clarification" and analysis.decide("절차는?").retrieval_query == "절차는?"
    assert analysis.guard_decision(analysis.Decision("ready", "r", ("sum_amount", "document_reason"), retrieval_query="q")).code == "cross_engine"
    assert analysis.guard_decision(analysis.Decision("ready", "r", ("sum_amount", "count_records"))).code == "several_operations" and analysis.guard_decision(analysis.Decision("ready", "r", ("sum_amount",))) is None


def test_plans_are_brought_into_line(table):
    p = QueryPlan(dataframe="df0", operation="list", filters=(FilterCondition("출연금액", "gt", "500,000"), FilterCondition("학과", "eq", 3.0)))
    out = analysis.aligned(p, "출연금액 500,000원 이상 또는 3", table)
    assert out.filters[0] == FilterCondition("출연금액", "gte", 500000.0, source_text="500,000원 이상") and out.filters[1].value == "3" and out.filter_logic == "any"
    ranked = QueryPlan(dataframe="df0", operation="list", sort=(SortCondition("출연금액", "desc"),), rank_position=2, filters=(FilterCondition("출연금액", "eq", 2),))
    assert analysis.aligned(ranked, "두 번째로 큰 금액", table).filters == ()
    model = iter(['{"dataframe": "df0", "operation": "list", "limit": 7}', '{"dataframe": "df0", "operation": "sum", "target": "출연금액"}'])
    assert analysis.planned("합계", table, lambda q: next(model), lambda p: validate(p, "합계", {"df0": table})).operation == "sum"
    assert analysis.planned("합계", table, lambda q: "[]", lambda p: []).status == "clarification"
    lookup = QueryPlan(dataframe="df0", operation="list", select=("이름",))
    assert [i.code for i in analysis.lookup_contract(lookup, "김철수의 학과", table)] == ["projection", "projection"]
    assert analysis.lookup_contract(plan(table, "경영학과 목록 보여줘"), "경영학과 목록 보여줘", table) == []


def test_absent_people_and_catalogs(table):
    tables = {"df0": table}
    assert analysis.absent_people(tables, "박민수의 출연금액은 얼마야") == ["박민수"]
    assert analysis.absent_people(tables, "추상철의 출연금액은 얼마야") == [] == analysis.absent_people(tables, "김철수 출연금액 합계") == analysis.absent_people(tables, "전체 출연금액 합계")
    assert analysis.people_catalog(tables) == (["김철수", "이영희", "추*철"], False) and analysis.people_catalog(tables, 2) == ([], True) and analysis.people_catalog({}) == ([], False)
    dates = analysis.date_catalog(table, "출연일자", F.col("출연일자").cast("timestamp")).collect()
    assert sorted((r["year"], r["month"], r["n"]) for r in dates) == [(2024, 3, 1), (2025, 3, 2), (2025, 4, 1)]


def test_schema_text_and_relevant_tables(spark, table):
    other = TableRef("df1", "규정.xlsx", spark.createDataFrame([(0, "x")], f"{POSITION} long, `항목` string"), {})
    text = analysis.schema_text({"df0": table, "df1": other})
    assert "010-1" not in text and "[민감정보]" in text and '"출연금액"=amount/amount' in text and "경영학과, 컴퓨터학과" in text and "(4행)" in text
    assert list(analysis.relevant_tables({"df0": table, "df1": other}, "경영학과 합계")) == ["df0"]
    assert list(analysis.relevant_tables({"df0": table, "df1": other}, "규정 알려줘")) == ["df1"] and len(analysis.relevant_tables({"df0": table, "df1": other}, "zzz")) == 2


def test_jobs_can_be_stopped(spark):
    with analysis.cancellable(spark) as stop:
        timer = threading.Timer(1.5, stop)
        timer.start()
        began = time.monotonic()
        with pytest.raises(Exception):  # noqa: B017, PT011
            spark.range(10**14, numPartitions=8).agg(F.sum(F.col("id") * F.col("id") % 7)).collect()
        assert time.monotonic() - began < 60
    timer.cancel()


def test_per_person_mean_and_months_without_a_year(spark, table):
    p = plan(table, "1인당 평균 출연금액")
    row = execute(p, table).result.collect()[0]
    assert p.result_mode == "per_person" and (row["value"], row["people"]) == (3_800_000 / 3, 3)
    p, narrowed = plan_dated(table, "모든 연도 3월 출연금액 합계")
    assert execute(p, narrowed).result.collect()[0]["value"] == 3_300_000
    assert plan_dated(table, "3월 출연금액 합계")[0].status == "clarification"
    one = TableRef("df0", "a.xlsx", table.frame.where("`출연일자` >= '2025'"), MEANINGS)
    assert execute(plan(one, "3월 출연금액 합계"), one).result.collect()[0]["value"] == 3_000_000


def test_units_of_columns_enter_the_check(spark):
    """Trap: a bare number takes the unit of its column, text says its own."""
    meanings = {"금액": ColumnMeaning("amount", "amount", "money", "KRW_10000")}
    t = TableRef("df0", "a.xlsx", spark.createDataFrame([(0, "100"), (1, "25"), (2, "10만원")], f"{POSITION} long, `금액` string"), meanings)
    p = plan(t, "금액 50만원 이상 몇 건이야?")
    assert p.filters[0].value == 50 and validate(p, "금액 50만원 이상 몇 건이야?", {"df0": t}) == [] and execute(p, t).result.collect()[0]["value"] == 1
    wrong = p.with_(filters=(FilterCondition("금액", "gte", 500000, source_text="50만원 이상"),))
    assert [i.code for i in validate(wrong, "금액 50만원 이상 몇 건이야?", {"df0": t})] == ["ungrounded"]
    bare = plan(t, "금액 50 이상 몇 건이야?")
    assert bare.filters[0].value == 50 and validate(bare, "금액 50 이상 몇 건이야?", {"df0": t}) == []


def test_values_are_found_however_many_there_are(spark):
    many = TableRef("df0", "a.xlsx", spark.range(7000).select(F.col("id").alias(POSITION), F.concat(F.lit("분야"), F.col("id").cast("string"), F.lit("호")).alias("분야")), {"분야": ColumnMeaning("category", "field")})
    assert plan(many, "분야６０００호 목록 보여줘").filters == (FilterCondition("분야", "eq", "분야6000호"),)


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], [3.0, None, 1.0, 2.0], [7.0] * 1000 + [1.0], [float(i % 977) for i in range(5000)], [1e300, -1e300, 0.0]])
def test_exact_median(spark, values):
    import statistics

    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    known = [v for v in values if v is not None]
    assert exact_median(rows, F.col("v")).collect()[0]["value"] == (statistics.median(known) if known else None)
    assert "percentile(v" not in exact_median(rows, F.col("v"))._jdf.queryExecution().toString()


def test_one_scan_for_a_profile(spark, tmp_path):
    spark.range(50).select(F.col("id").alias(POSITION), *(F.col("id").cast("string").alias(f"c{i}") for i in range(6))).write.parquet(f"file://{tmp_path}/t")
    found = schema.profile(spark.read.parquet(f"file://{tmp_path}/t"))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and {(r["column"], r["cells"], r["sequence"]) for r in found.collect()} == {(f"c{i}", 50, True) for i in range(6)}


def test_qualifiers_profiles_and_source_columns(spark):
    assert [schema.qualifier(h) for h in ("출연금액", "지급액", "교부액", "본예산금액", "결제금액", "지급기관", "집행금액", "납부금")] == ["donation", "payment", "allocated", "budget", None, None, "executed", None]
    held = schema.Profiles()
    df = spark.createDataFrame([(0, "김철수", "1,000")], f"{POSITION} long, `성명` string, `지급액` string")
    first = held.of(df)
    held.held[schema.fingerprint(first)] = first | {"지급액": ColumnMeaning("amount", "amount", "money", "KRW_10000")}
    assert held.of(df)["지급액"].unit == "KRW_10000" and schema.is_person_column("성명", {}) and schema.is_person_column("성명", first)
    assert [schema.is_source_column(c, {"표": ColumnMeaning(is_derived=True)}) for c in ("성명", "_x", "row_uid", "표")] == [True, False, False, False]


def test_lookup_phrases_and_words():
    assert scope.lookup_phrase("주식회사 하나의 출연금액은 얼마야?") == "주식회사 하나의" and scope.lookup_phrase("하나재단 총액 알려 줘!") == "하나재단"
    assert scope.value_words("경영학과 3학년 2024년 장학금을 알려줘") == ["경영학과", "경영학", "장학금을", "3학년", "2024"]
    assert scope.name_words("김 * 수의 금액") == ["김*수", "금"] or "김*수" in scope.name_words("김*수의 금액")
    assert scope.tables_named({}, "x") == [] and scope.cell_conditions({}, "경영학과") == {}
    assert scope.all_records({}).notice.kind == "empty"


def test_searches_of_empty_tables(spark, table):
    none = {"df0": TableRef("df0", "a.xlsx", table.frame.limit(0), MEANINGS)}
    assert scope.all_records(none).rows.collect() == [] and scope.cell_conditions(none, "경영학과") == {}
    assert scope.name_search(none, "김철수 금액").rows.collect() == [] and scope.identifier_search(none, "2024-00012").notice.kind == "empty"
    assert scope.date_search(none, scope.Span((2025, 3), (2025, 3)), "2025년 3월").rows.collect() == []


def test_expanded_queries():
    out = answers.expanded_queries("공대 졸업 예정자도 추천 가능한 조건인가요", variants=lambda q: ["다른 말", "", "또 다른 말", "셋째"])
    assert out[0].startswith("공대") and "선발기준 자격 요건 성적 기준" in out and "공과대학 수업연한 이내 졸업 예정 수료 예정 추천 가능 제외 예외" in out and out[-2:] == ["다른 말", "또 다른 말"]
    assert answers.expanded_queries("대학원도 장학금 지원되나")[0] == "장학금 선발 대상 학부 재학생 대학원생 지원 대상"
    assert answers.expanded_queries("장학규정집 문서의 목적 설명", explains=True)[0] == "[문서 개요] 장학규정집"


def test_answer_checks():
    assert answers.repaired_difference("차이는?", "차이는 30점입니다. 90점과 50점") == "차이는 40점입니다. 90점과 50점"
    assert answers.repaired_difference("차이는?", "차이는 30점입니다. 90점, 50점, 10점") == "차이는 30점입니다. 90점, 50점, 10점"
    assert answers.repaired_difference("차이는?", "차이는 3점. 90점 - 50점 = 40점") == "차이는 40점. 90점 - 50점 = 40점" and answers.repaired_difference("몇 점?", "x") == "x"
    assert answers.without_empty_paragraphs("가\n\n- \n\n\n\n1.\n나") == "가\n\n나"
    assert answers.contradiction("추천이 가능합니다. 다만 졸업자는 불가합니다.") and not answers.contradiction("가능합니다. 서류를 내세요.")
    assert answers.with_exception("모두 제외되나요 졸업 예정자", "제외됩니다.", ["졸업 예정자는 추천 가능"]).endswith("- 졸업 예정자는 추천 가능") and answers.with_exception("누구인가", "x", ["예외"]) == "x"
    assert answers.table_notes("1구간 2구간 3구간\n반영점수 30 20 10") == ["1구간 = 30점, 2구간 = 20점, 3구간 = 10점"]
    assert answers.table_notes("5 10\n1 6\n11\n반영점수 3 2 1") == ["1~5 = 3점, 6~10 = 2점, 11 = 1점"]
    notes = answers.condition_notes("직전학기 평점 3.0인데 되나요", ["- 자격 요건: 직전학기 평점평균 3.5 이상"])
    assert notes.splitlines() == ["[질문 조건 정렬 보조] 직전학기 평점 3.0", "[문서 필수 조건 정렬 보조] 자격 요건: 직전학기 평점평균 3.5 이상", "[문서 수치 기준 정렬 보조] 직전학기 평점평균 3.5 이상"]


def test_items_find_their_sections():
    titles, bodies = ["1. 지원 대상", "2. 선발 기준", "3. 일정"], ["", "본문", ""]
    assert sections.items_in_sections(titles, bodies, [("□ 대상 학생", "가"), ("■ 성적 기준", "나"), ("◇ 그 밖에", "다")]) == ["가", "나\n\n다", "3. 일정"]
    assert sections.items_in_sections(["1. 하나"], [""], []) == ["1. 하나"]


def test_sections_of_odd_documents(spark):
    rows = [("a", None), ("b", ""), ("c", "짧음"), ("d", "1. 제목\n" + "본문입니다. " * 200), ("e", "x" * 3000)]
    found = sections.text_sections(spark.createDataFrame(rows, "source string, text string")).collect()
    assert {r["source"] for r in found} == {"d", "e"} and {r["section_id"] for r in found if r["source"] == "e"} == {None}
    d = sorted((r["child_index"], r["child_count"], r["section_title"]) for r in found if r["source"] == "d")
    assert [x[0] for x in d] == list(range(len(d))) and {x[1:] for x in d} == {(len(d), "1. 제목")}
