"""Registered queries over several tables and their SQL.

Three tables of people are derived from customers, the same way for Spark and for SQL: two sheets of one document, which share some rows,
and one of another document with months in columns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.operators import nameblocks, scope
from ledgerloom.operators.cellindex import CellIndex
from ledgerloom.operators.nameblocks import NameIndex
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef
from ledgerloom.registry import read, register
from ledgerloom.sources.store import new_folder

FAMILY, FIRST, SECOND = "김이박최정강조", "민서지하도수예현", "준연우은호아진영원"
DEPARTMENTS = ("경영학과", "전기과", "기계과")
DONATIONS, GRANTS = "2024_기부_대장.xlsx", "2025_장학_명단.xlsx"

_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
TABLES_SQL = f"""WITH people AS (
  SELECT c_custkey AS k, concat('row', CAST(c_custkey AS VARCHAR)) AS uid,
    concat(({_list(FAMILY)})[CAST(c_custkey % 7 AS INT) + 1], ({_list(FIRST)})[CAST(c_custkey // 7 % 8 AS INT) + 1], ({_list(SECOND)})[CAST(c_custkey // 56 % 9 AS INT) + 1]) AS name,
    ({_list(DEPARTMENTS)})[CAST(c_custkey % 3 AS INT) + 1] AS dept, c_custkey // 2 % 4 + 1 AS grade, c_custkey % 60 AS cohort,
    CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 1000.0 END AS amount, DATE '2024-01-01' + CAST(c_custkey % 366 AS INT) AS paid_on,
    c_custkey % 5 = 0 AS hidden, c_custkey % 13 = 0 AS org FROM customer),
d0 AS (SELECT * FROM people WHERE k % 2 = 0), d1 AS (SELECT * FROM people WHERE k % 3 = 0),
both_ AS (SELECT *, 0 AS part FROM d0 UNION ALL SELECT *, 1 FROM d1 WHERE k % 2 <> 0),
d2 AS (SELECT *, k % 12 + 1 AS m, 2024 + k % 2 AS y FROM people WHERE k % 5 = 2)
"""

MEANINGS = {
    "이름": ColumnMeaning("entity", "person", "string"),
    "출연금액": ColumnMeaning("amount", "amount", "money", "KRW"),
    "출연일자": ColumnMeaning("temporal", "date", "date"),
    "기수": ColumnMeaning("category", "cohort", "string"),
    "학과": ColumnMeaning("category", "department", "string"),
    "발행번호": ColumnMeaning("identifier", "identifier", "string"),
}
GRANT_MEANINGS = {"성명": ColumnMeaning("entity", "person", "string"), "월": ColumnMeaning("temporal", "month", "string"), "연도": ColumnMeaning("temporal", "year", "string"), "지급액": ColumnMeaning("amount", "amount", "money", "KRW")}


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all three tables."""
    k = F.col("c_custkey")
    letter = lambda letters, n: F.element_at(F.array(*map(F.lit, letters)), (n % len(letters)).cast("int") + 1)
    name = F.concat(letter(FAMILY, k), letter(FIRST, F.floor(k / 7)), letter(SECOND, F.floor(k / 56)))
    hidden = k % 5 == 0
    return read(spark, sf_dir, "customer").select(
        k.alias(POSITION),
        F.concat(F.lit("row"), k.cast("string")).alias("row_uid"),
        name.alias("이름"),
        F.when(k % 13 != 0, F.when(hidden, names.masked_form(name)).otherwise(name)).alias("성명_검색키"),
        names.masked_form(name).alias("성명_마스킹패턴"),
        hidden.alias("성명_마스킹여부"),
        F.when(k % 13 == 0, "주식회사 가나다").alias("기관명"),
        F.when(k % 13 == 0, "organization").when(hidden, "person_masked").otherwise("person").alias("entity_type"),
        letter(DEPARTMENTS, k).alias("학과"),
        F.concat((F.floor(k / 2) % 4 + 1).cast("string"), F.lit("학년")).alias("학년"),
        F.concat((k % 60).cast("string"), F.lit("기")).alias("기수"),
        F.when(k % 11 != 0, k * 1000.0).alias("출연금액"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 366).cast("int")).alias("출연일자"),
        F.concat(F.lit("2024-"), F.lpad(k.cast("string"), 5, "0")).alias("발행번호"),
    )


def donation_tables(spark: SparkSession, sf_dir: str) -> scope.Tables:
    rows = people(spark, sf_dir)
    first, second = rows.where(F.col(POSITION) % 2 == 0), rows.where(F.col(POSITION) % 3 == 0)
    return {"df0": TableRef("df0", DONATIONS, first, MEANINGS, "기부대장"), "df1": TableRef("df1", DONATIONS, second, MEANINGS, "기부대장 2")}


def grant_table(spark: SparkSession, sf_dir: str) -> TableRef:
    k = F.col(POSITION)
    rows = people(spark, sf_dir).where(k % 5 == 2).select(
        POSITION,
        F.col("이름").alias("성명"),
        F.concat((k % 12 + 1).cast("string"), F.lit("월")).alias("월"),
        F.concat((k % 2 + 2024).cast("string"), F.lit("년")).alias("연도"),
        F.col("출연금액").alias("지급액"),
        F.when(k % 2 == 1, F.concat(F.lit("지급처"), k.cast("string"))).otherwise(" ").alias("지급처"),
    )
    return TableRef("df2", GRANTS, rows, GRANT_MEANINGS, "장학명단")


def all_tables(spark: SparkSession, sf_dir: str) -> scope.Tables:
    return donation_tables(spark, sf_dir) | {"df2": grant_table(spark, sf_dir)}


def keyed(found: scope.Found, *more: Column) -> DataFrame:
    return found.rows.select(F.col(POSITION).alias("key"), *more)


def scope_query(name: str, sql: str):
    return register(name, TABLES_SQL + sql, ledger_sql=False)


@scope_query("all_records", f"SELECT k AS key, '{DONATIONS}' AS source FROM both_")
def _(spark, sf_dir):
    return keyed(scope.all_records(donation_tables(spark, sf_dir)), F.col("source"))


@scope_query("all_records_asks_back", f"SELECT 'clarification' AS kind, '{DONATIONS}' AS first_source, '{GRANTS}' AS second_source")
def _(spark, sf_dir):
    notice = scope.all_records(all_tables(spark, sf_dir)).notice
    return spark.createDataFrame([(notice.kind, *notice.sources)], "kind string, first_source string, second_source string")


@scope_query("scope_union", "SELECT count(*) AS n_rows, sum(amount) AS total FROM both_")
def _(spark, sf_dir):
    rows = scope.aggregation_scope(all_tables(spark, sf_dir), "기부 대장에서 출연금액 합계").rows
    return rows.agg(F.count("*").alias("n_rows"), F.sum("출연금액").alias("total"))


@scope_query("scope_cells", "SELECT k AS key FROM d0 WHERE dept = '경영학과' AND grade = 3")
def _(spark, sf_dir):
    return keyed(scope.aggregation_scope(donation_tables(spark, sf_dir), "경영학과 3학년 출연금액 합계"))


@scope_query("cell_conditions", "SELECT * FROM (VALUES ('df0', '학과', '경영학과'), ('df0', '학년', '3학년'), ('df1', '학과', '경영학과'), ('df1', '학년', '3학년')) t(alias, \"column\", word) WHERE (SELECT count(*) FROM d0 WHERE dept = '경영학과') > 0 AND (SELECT count(*) FROM d1 WHERE grade = 3) > 0")
def _(spark, sf_dir):
    found = scope.cell_conditions(all_tables(spark, sf_dir), "경영학과 3학년 출연금액")
    return spark.createDataFrame([(a, c, w) for a, pairs in found.items() for c, w in pairs], "alias string, column string, word string")


INDEXED = {"df0": ["이름", "학과", "학년", "기수", "발행번호"], "df2": ["성명", "월", "연도", "지급처"]}
INDEXED["df1"] = INDEXED["df0"]
_OF = "SELECT '{0}', '이름', name FROM {1} UNION ALL SELECT '{0}', '학과', dept FROM {1} UNION ALL SELECT '{0}', '학년', concat(CAST(grade AS VARCHAR), '학년') FROM {1} UNION ALL SELECT '{0}', '기수', concat(CAST(cohort AS VARCHAR), '기') FROM {1} UNION ALL SELECT '{0}', '발행번호', concat('2024-', lpad(CAST(k AS VARCHAR), 5, '0')) FROM {1}"
_CELLS = f"""cells(source, "column", value) AS (SELECT DISTINCT * FROM ({_OF.format('df0', 'd0')} UNION ALL {_OF.format('df1', 'd1')} UNION ALL SELECT 'df2', '성명', name FROM d2
  UNION ALL SELECT 'df2', '월', concat(CAST(m AS VARCHAR), '월') FROM d2 UNION ALL SELECT 'df2', '연도', concat(CAST(y AS VARCHAR), '년') FROM d2 UNION ALL SELECT 'df2', '지급처', CASE WHEN k % 2 = 1 THEN concat('지급처', CAST(k AS VARCHAR)) ELSE ' ' END FROM d2)),
words AS (SELECT DISTINCT unnest([name[2:3], dept, dept[2:], concat(CAST(grade AS VARCHAR), '학년'), lpad(CAST(k % 1000 AS VARCHAR), 3, '0'), concat(CAST(k AS VARCHAR), '기'), concat(name, '님')]) AS word FROM people)"""


def indexed(spark: SparkSession, sf_dir: str) -> CellIndex:
    index = CellIndex(spark, new_folder(spark, "cells"))
    index.put(all_tables(spark, sf_dir), lambda t: INDEXED[t.alias])
    return index


@scope_query("cell_index", f""", {_CELLS} SELECT DISTINCT source, "column", word FROM cells, words WHERE contains(value, word)""")
def _(spark, sf_dir):
    """Which columns of three tables hold each of the words made from all people, by the index alone."""
    k, name = F.col(POSITION), F.col("이름")
    made = F.array(F.substring(name, 2, 2), "학과", F.substring("학과", 2, 9), "학년", F.lpad((k % 1000).cast("string"), 3, "0"), F.concat(k.cast("string"), F.lit("기")), F.concat(name, F.lit("님")))
    words = people(spark, sf_dir).select(F.explode(made).alias("word"))
    return indexed(spark, sf_dir).holding(words).select("source", "column", "word")


@scope_query("cells_of_tables", f""", {_CELLS} SELECT source, "column", count(*) AS n FROM cells WHERE value <> '' GROUP BY ALL""")
def _(spark, sf_dir):
    """Distinct cells of each indexed column after the tables were put in twice and one was taken out and put back."""
    index, tables = indexed(spark, sf_dir), all_tables(spark, sf_dir)
    index.drop(["df2"])
    index.put({"df2": tables["df2"], "df0": tables["df0"]}, lambda t: INDEXED[t.alias])
    return index.store.read().where("kind = 0").select("source", "column", "value").distinct().groupBy("source", "column").agg(F.count("*").alias("n"))


@scope_query("direct_lookup_grade", "SELECT k AS key FROM d0 WHERE dept = '전기과' AND grade = 2")
def _(spark, sf_dir):
    return keyed(scope.direct_lookup(donation_tables(spark, sf_dir), "기부 대장 전기과 2학년 명단"))


@scope_query("grade_filter", "SELECT k AS key FROM d0 WHERE grade = 2")
def _(spark, sf_dir):
    return scope.of_grade(donation_tables(spark, sf_dir)["df0"].frame, "2학년 학생").select(F.col(POSITION).alias("key"))


@scope_query("identifier_targets", "SELECT * FROM (VALUES (0, '202400012'), (1, '202400018')) t(place, identifier)")
def _(spark, sf_dir):
    found = scope.identifier_targets(all_tables(spark, sf_dir), "2024-00012 그리고 발행번호 2024 00018")
    return spark.createDataFrame(list(enumerate(found)), "place int, identifier string")


@scope_query("identifier_tables", "SELECT k AS key, '202400012' AS identifier FROM both_ WHERE k = 12")
def _(spark, sf_dir):
    return keyed(scope.identifier_search(all_tables(spark, sf_dir), "발행번호 2024-00012 내역"), F.col("_identifier").alias("identifier"))


@scope_query("cohort_tables", "SELECT k AS key FROM both_ WHERE cohort = 24")
def _(spark, sf_dir):
    return keyed(scope.cohort_search(all_tables(spark, sf_dir), "24기 기부자"))


@scope_query("source_year", "SELECT k AS key FROM d2")
def _(spark, sf_dir):
    tables = all_tables(spark, sf_dir)
    return scope.of_last_year(scope.together([scope.sourced(t) for t in tables.values()]), "2024년 말고 2025년").select(F.col(POSITION).alias("key"))


@scope_query("organisation_mask", "SELECT k AS key, org AS may_be FROM d0")
def _(spark, sf_dir):
    rows = donation_tables(spark, sf_dir)["df0"].frame
    return rows.select(F.col(POSITION).alias("key"), scope.may_be_organisation(rows.columns).alias("may_be"))


@scope_query("organisation_tables", "SELECT k AS key, 1 AS match_rank FROM both_ WHERE org")
def _(spark, sf_dir):
    return keyed(scope.organisation_rows(donation_tables(spark, sf_dir), "가나다 출연금 얼마야?"), F.col("_rank").alias("match_rank"))


@scope_query("name_search_tables", "SELECT k AS key, 'exact_match' AS match FROM both_ WHERE name = '김민준' AND NOT hidden AND NOT org AND amount IS NOT NULL")
def _(spark, sf_dir):
    return keyed(scope.name_search(all_tables(spark, sf_dir), "김민준의 출연금액"), F.col("_match").alias("match"))


@scope_query("name_search_tables_masked", "SELECT k AS key, 'masked_candidate_match' AS match FROM (SELECT * FROM both_ WHERE hidden AND NOT org AND amount IS NOT NULL) WHERE left(name, 1) = '이' AND right(name, 1) = '준' AND length(name) = 3")
def _(spark, sf_dir):
    tables = {a: TableRef(a, t.source, t.frame.where("`성명_마스킹여부`"), t.meanings, t.label) for a, t in donation_tables(spark, sf_dir).items()}
    return keyed(scope.name_search(tables, "이민준 알려줘"), F.col("_match").alias("match"))


@scope_query("name_search_index", "SELECT k AS key, 'exact_match' AS match FROM both_ WHERE name = '김민준' AND NOT hidden AND NOT org AND amount IS NOT NULL")
def _(spark, sf_dir):
    """The same search, with the rows to look at from an index of names."""
    tables, index = all_tables(spark, sf_dir), NameIndex(spark, new_folder(spark, "names"))
    scope.index_names(index, tables)
    return keyed(scope.name_search(tables, "김민준의 출연금액", index), F.col("_match").alias("match"))


@scope_query("nearest_masks", """, made AS (SELECT DISTINCT CASE WHEN k % 3 = 0 THEN concat(name[1], '*', name[3]) WHEN k % 3 = 1 THEN concat(name[1:2], '*') ELSE concat(name[1], '**', name[3]) END AS mask, k % 20 = 0 AS asked FROM people),
pairs AS (SELECT a.mask AS query, b.mask AS name, list_filter(list_transform(range(1, length(a.mask) + 1), lambda i: abs(unicode(a.mask[i]) - unicode(b.mask[i]))), lambda g: g > 0) AS gaps FROM made a JOIN made b ON a.asked AND length(a.mask) = length(b.mask) AND a.mask[1] = b.mask[1] AND regexp_replace(a.mask, '[가-힣]', '가', 'g') = regexp_replace(b.mask, '[가-힣]', '가', 'g')),
near AS (SELECT query, name, CAST(coalesce(list_sum(gaps), 0) AS INT) AS distance FROM pairs WHERE len(gaps) <= 1 AND coalesce(list_sum(gaps), 0) <= 180)
SELECT DISTINCT query, name, distance FROM near QUALIFY distance = min(distance) OVER (PARTITION BY query)""")
def _(spark, sf_dir):
    """The nearest of all masks for those of every person whose number is divisible by 20; a mask that is stored itself is nearest."""
    k, name = F.col(POSITION), F.col("이름")
    mask = F.when(k % 3 == 0, F.concat(F.left(name, F.lit(1)), F.lit("*"), F.right(name, F.lit(1)))).when(k % 3 == 1, F.concat(F.left(name, F.lit(2)), F.lit("*"))).otherwise(F.concat(F.left(name, F.lit(1)), F.lit("**"), F.right(name, F.lit(1))))
    made = people(spark, sf_dir).select(k, mask.alias("name"))
    return nameblocks.nearest(made.where(k % 20 == 0).select(F.col("name").alias("query")), made)


@scope_query("name_search_narrowed", "SELECT k AS key FROM both_ WHERE name = '김민준' AND NOT hidden AND NOT org AND amount IS NOT NULL AND cohort = 24")
def _(spark, sf_dir):
    return keyed(scope.name_search(donation_tables(spark, sf_dir), "24기 김민준의 출연금액"))


@scope_query("date_all_tables", "SELECT k AS key FROM both_ WHERE paid_on BETWEEN DATE '2024-03-01' AND DATE '2024-05-31' AND dept = '경영학과'")
def _(spark, sf_dir):
    question = "2024년 3월부터 5월까지 경영학과 내역"
    return keyed(scope.date_search(donation_tables(spark, sf_dir), scope.Span((2024, 3), (2024, 5)), question, "2024년 3월부터 5월까지"))


@scope_query(
    "date_evidence",
    f"SELECT '{DONATIONS}' AS source, '출연일자' AS \"column\", '2024년 3~5월' AS period, count(*) FILTER (month(paid_on) BETWEEN 3 AND 5) AS matched_rows, 0 AS invalid_rows, CAST(min(year(paid_on)) FILTER (month(paid_on) BETWEEN 3 AND 5) AS INT) AS first_year, CAST(max(year(paid_on)) FILTER (month(paid_on) BETWEEN 3 AND 5) AS INT) AS last_year FROM d0 UNION ALL SELECT '{DONATIONS}', '출연일자', '2024년 3~5월', count(*) FILTER (month(paid_on) BETWEEN 3 AND 5), 0, CAST(min(year(paid_on)) FILTER (month(paid_on) BETWEEN 3 AND 5) AS INT), CAST(max(year(paid_on)) FILTER (month(paid_on) BETWEEN 3 AND 5) AS INT) FROM d1",
)
def _(spark, sf_dir):
    return scope.date_search(donation_tables(spark, sf_dir), scope.Span((None, 3), (None, 5)), "3월부터 5월까지").evidence


@scope_query("date_every_year", "SELECT k AS key FROM d2 WHERE m BETWEEN 2 AND 4")
def _(spark, sf_dir):
    return keyed(scope.date_search({"df2": grant_table(spark, sf_dir)}, scope.Span((None, 2), (None, 4), True), "모든 연도 2월부터 4월까지"))


@scope_query("date_components_year", "SELECT k AS key FROM d2 WHERE y * 100 + m BETWEEN 202411 AND 202502")
def _(spark, sf_dir):
    return keyed(scope.date_search({"df2": grant_table(spark, sf_dir)}, scope.Span((2024, 11), (2025, 2)), "2024년 11월부터 2025년 2월까지", "2024년 11월부터 2025년 2월까지"))


@scope_query("date_asks_for_year", "SELECT CASE WHEN count(DISTINCT y) > 1 THEN 'clarification' END AS kind FROM d2")
def _(spark, sf_dir):
    return spark.createDataFrame([(scope.date_search({"df2": grant_table(spark, sf_dir)}, scope.Span((None, 2), (None, 4)), "2월부터 4월까지").notice.kind,)], "kind string")


@scope_query("person_list", f"SELECT source, name, dept FROM (SELECT '{DONATIONS}' AS source, replace(name, ' ', '') AS name, dept, row_number() OVER (PARTITION BY CASE WHEN hidden THEN concat(left(name, 1), '*', right(name, 1)) ELSE name END ORDER BY k) AS r FROM both_ WHERE NOT org AND paid_on BETWEEN DATE '2024-02-01' AND DATE '2024-02-29') WHERE r = 1")
def _(spark, sf_dir):
    rows = scope.date_search(donation_tables(spark, sf_dir), scope.Span((2024, 2), (2024, 2)), "2024년 2월에 낸 사람", "2024년 2월").rows
    return scope.person_list(rows).select("source", F.col("이름").alias("name"), F.col("학과").alias("dept"))


@scope_query("payee", "SELECT concat('지급처', CAST(min(k) AS VARCHAR)) AS payee FROM d2 WHERE k % 2 = 1")
def _(spark, sf_dir):
    return scope.payee(all_tables(spark, sf_dir))


@scope_query("valid_name_rows", "SELECT count(*) FILTER (k % 3 <> 0) AS n FROM d0")
def _(spark, sf_dir):
    rows = donation_tables(spark, sf_dir)["df0"].frame
    return scope.valid_name_rows(rows.withColumn("이름", F.when(F.col(POSITION) % 3 == 0, F.lit(" nan ")).otherwise(F.col("이름"))))


@scope_query("entity_seed", "SELECT k AS key, concat('entity_', substr(sha256(CASE WHEN k % 3 = 0 THEN concat('candidate|c', CAST(k AS VARCHAR), '|', name) WHEN k % 2 = 0 THEN concat('contact|', name, '|010', CAST(k AS VARCHAR)) ELSE concat('name|', name) END), 1, 20)) AS entity FROM people")
def _(spark, sf_dir):
    k = F.col(POSITION)
    candidate, phone = F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"))), F.when(k % 2 == 0, F.concat(F.lit("010-"), k.cast("string")))
    return people(spark, sf_dir).select(k.alias("key"), scope.entity_seed(F.col("이름"), candidate, [phone]).alias("entity"))
