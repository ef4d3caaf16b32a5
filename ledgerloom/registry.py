"""Registry of the table-analytics queries and their SQL.

A ledger of payments is derived from orders and customers, the same way for Spark and for SQL. The tables
hold no blanks, masks, units or shared names, so such cells are derived from keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names
from ledgerloom.functions.money import money
from ledgerloom.operators import clean, compare, evidence, identity, retrieval, schema
from ledgerloom.plans.execute import execute
from ledgerloom.plans import results
from ledgerloom.plans.model import FilterCondition, QueryPlan, SortCondition
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef
from ledgerloom.sources import catalog, grids
from ledgerloom.sources.store import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

LEDGER_SQL = """WITH ledger AS (
  SELECT o_orderkey AS pos, c_name AS person, o_totalprice AS amount, o_orderdate AS paid_on, c_mktsegment AS department, c_nationkey AS cohort,
    o_orderstatus AS kind, year(o_orderdate) AS y, month(o_orderdate) AS m,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'None' ELSE o_orderpriority END AS memo,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS support,
    CASE WHEN o_orderkey % 17 = 0 THEN '잘못된값' WHEN o_orderkey % 5 = 0 THEN concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '원') WHEN o_orderkey % 3 = 0 THEN concat('-', CAST(o_custkey AS VARCHAR), '만원') ELSE concat('₩', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) END AS amount_text
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""

MEANINGS = {
    "person": ColumnMeaning("entity", "person", "string"),
    "amount": ColumnMeaning("amount", "amount", "money", "KRW"),
    "support": ColumnMeaning("amount", "amount", "money", "KRW"),
    "amount_text": ColumnMeaning("amount", "amount", "money", "KRW"),
    "paid_on": ColumnMeaning("temporal", "date", "date"),
    "department": ColumnMeaning("category", "department", "string"),
    "cohort": ColumnMeaning("category", "cohort", "number"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    floor = F.floor("o_totalprice").cast("string")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias(POSITION),
        F.col("c_name").alias("person"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("paid_on"),
        F.col("c_mktsegment").alias("department"),
        F.col("c_nationkey").alias("cohort"),
        F.col("o_orderstatus").alias("kind"),
        F.when(key % 7 == 0, None).when(key % 11 == 0, "").when(key % 13 == 0, "None").otherwise(F.col("o_orderpriority")).alias("memo"),
        F.when(key % 9 == 0, None).otherwise(F.col("o_totalprice")).alias("support"),
        F.when(key % 17 == 0, "잘못된값").when(key % 5 == 0, F.concat(floor, F.lit("원"))).when(key % 3 == 0, F.concat(F.lit("-"), F.col("o_custkey").cast("string"), F.lit("만원"))).otherwise(F.concat(F.lit("₩"), floor)).alias("amount_text"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> TableRef:
    return TableRef("df0", "ledger.xlsx", ledger_frame(spark, sf_dir), MEANINGS, "ledger")


def register(name: str, sql: str | None = None, ledger_sql: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (LEDGER_SQL if ledger_sql else "") + sql
        return f

    return add


def plan_query(name: str, sql: str, shape: Callable[[DataFrame], DataFrame] | None = None, part: str = "result", **plan) -> None:
    """A query that runs a plan over the ledger."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = getattr(execute(QueryPlan(dataframe="df0", **plan), ledger(spark, sf_dir)), part)
        return shape(out) if shape else out

    register(name, sql)(run)


def where(column: str, operator: str, value=None, **more) -> FilterCondition:
    return FilterCondition(column, operator, value, **more)


def cents(c: str, digits: int = 2) -> Column:
    return F.round(F.col(c), digits)


# Filters: counts of matched rows beside a sum that tells the rows apart.
def filter_query(name: str, predicate: str, *filters: FilterCondition, logic: str = "all") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        matched = execute(QueryPlan(dataframe="df0", operation="list", filters=filters, filter_logic=logic), ledger(spark, sf_dir)).matched
        return matched.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(POSITION), F.lit(0)).alias("key_sum"))

    register(name, f"SELECT count(*) AS n_rows, CAST(coalesce(sum(pos), 0) AS BIGINT) AS key_sum FROM ledger WHERE {predicate}")(run)


filter_query("filter_eq_ci", "lower(trim(department)) = 'building'", where("department", "eq", "building"))
filter_query("filter_eq_cs", "trim(department) = 'building'", where("department", "eq", "building", case_sensitive=True))
filter_query("filter_ne_null_text", "coalesce(lower(trim(memo)) <> '1-urgent', false)", where("memo", "ne", "1-URGENT"))
filter_query("filter_ne_null_number", "support IS DISTINCT FROM 1000", where("support", "ne", 1000))
filter_query("filter_in_cs", "department IN ('BUILDING', 'machinery')", where("department", "in", ("BUILDING", "machinery")))
filter_query("filter_contains", "contains(lower(person), '00001')", where("person", "contains", "00001"))
filter_query("filter_contains_cs", "contains(trim(memo), 'urgent')", where("memo", "contains", "urgent", case_sensitive=True))
filter_query("filter_gt", "amount > 100000", where("amount", "gt", 100000))
filter_query("filter_gte", "cohort >= 20", where("cohort", "gte", 20))
filter_query("filter_lt", "support < 20000", where("support", "lt", 20000))
filter_query("filter_lte", "paid_on <= TIMESTAMP '1997-03-01'", where("paid_on", "lte", "1997-03-01"))
filter_query("filter_between", "amount BETWEEN 50000 AND 60000", where("amount", "between", (50000, 60000)))
filter_query("filter_isnull_text", "memo IS NULL OR lower(trim(memo)) IN ('', 'none', 'nan', 'nat', 'null')", where("memo", "is_null"))
filter_query("filter_isnull_money", "pos % 17 = 0", where("amount_text", "is_null"))
filter_query("filter_notnull", "memo IS NOT NULL AND lower(trim(memo)) NOT IN ('', 'none', 'nan', 'nat', 'null')", where("memo", "not_null"))
filter_query("filter_any", "lower(department) = 'building' OR coalesce(support < 5000, false)", where("department", "eq", "BUILDING"), where("support", "lt", 5000), logic="any")
filter_query("filter_money_literal", "amount >= 200000", where("amount", "gte", "20만원"))

# Lists, ranks and extremes.
_RANKED = "SELECT person, amount FROM ledger"
plan_query("list_sort_limit", f"{_RANKED} ORDER BY amount DESC NULLS LAST, pos LIMIT 50", operation="list", select=("person", "amount"), sort=(SortCondition("amount", "desc"),), limit=50)
plan_query("list_nulls_last", "SELECT support, kind FROM ledger ORDER BY support ASC NULLS LAST, pos LIMIT 500", operation="list", select=("support", "kind"), sort=(SortCondition("support"),), limit=500)
plan_query("list_default_columns", "SELECT person, amount, paid_on, department, cohort, kind, memo, support, amount_text FROM ledger WHERE cohort = 7", operation="list", filters=(where("cohort", "eq", 7),))
plan_query("list_distinct_first", "SELECT department, cohort, kind, amount FROM (SELECT *, row_number() OVER (PARTITION BY department, cohort ORDER BY pos) AS r FROM ledger) WHERE r = 1", operation="list", select=("department", "cohort", "kind", "amount"), distinct_by=("department", "cohort"))
plan_query("list_dense_rank", "SELECT person, cohort, amount FROM (SELECT *, dense_rank() OVER (ORDER BY cohort DESC) AS r FROM ledger WHERE cohort IS NOT NULL) WHERE r = 3", operation="list", select=("person", "cohort", "amount"), sort=(SortCondition("cohort", "desc"),), rank_position=3)
plan_query("extreme_top1_ties", "SELECT cohort, kind, amount FROM ledger WHERE cohort = (SELECT max(cohort) FROM ledger)", operation="max", target="cohort", result_mode="records", select=("cohort", "kind", "amount"))
plan_query("extreme_topn", "SELECT person, amount FROM ledger ORDER BY amount, pos LIMIT 10", operation="min", target="amount", result_mode="records", top_n=10, select=("person", "amount"))

# Aggregates.
plan_query("agg_count", "SELECT count(*) AS value FROM ledger WHERE amount > 100000", operation="count", filters=(where("amount", "gt", 100000),))
plan_query("agg_count_target", "SELECT count(support) AS value FROM ledger", operation="count", target="support")
plan_query("agg_people", "SELECT count(DISTINCT person) AS value FROM ledger WHERE kind = 'F'", operation="count", filters=(where("kind", "eq", "F"),), distinct_by=("person",))
plan_query("agg_sum", "SELECT round(sum(support), 2) AS value FROM ledger", lambda d: d.select(cents("value").alias("value")), operation="sum", target="support")
plan_query("agg_sum_empty", "SELECT sum(support) AS value FROM ledger WHERE amount < 0", operation="sum", target="support", filters=(where("amount", "lt", 0),))
plan_query("agg_sum_text", "SELECT sum(CASE WHEN pos % 17 = 0 THEN NULL WHEN pos % 5 = 0 THEN floor(amount) WHEN pos % 3 = 0 THEN -10000.0 * CAST(regexp_extract(amount_text, '\\d+') AS DOUBLE) ELSE floor(amount) END) AS value FROM ledger", operation="sum", target="amount_text")
plan_query("agg_mean", "SELECT round(avg(support), 4) AS value FROM ledger", lambda d: d.select(cents("value", 4).alias("value")), operation="mean", target="support")
plan_query("agg_median", "SELECT round(median(support), 4) AS value FROM ledger", lambda d: d.select(cents("value", 4).alias("value")), operation="median", target="support")
plan_query("agg_mode_ties", "SELECT CAST(cohort AS DOUBLE) AS value, times FROM (SELECT cohort, count(*) AS times, max(count(*)) OVER () AS best FROM ledger WHERE cohort IS NOT NULL GROUP BY cohort) WHERE times = best", lambda d: d.select("value", "times"), operation="mode", target="cohort")
plan_query("agg_min", "SELECT min(amount) AS value FROM ledger", operation="min", target="amount")
plan_query("agg_max_date", "SELECT max(paid_on) AS value FROM ledger", operation="max", target="paid_on")
plan_query(
    "agg_evidence",
    "SELECT count(*) AS source_rows, count(*) FILTER (kind = 'F') AS filtered_rows, count(*) FILTER (kind = 'F') AS matched_rows, count(support) FILTER (kind = 'F') AS valid_rows, count(*) FILTER (kind = 'F' AND support IS NULL) AS excluded_rows, count(DISTINCT person) FILTER (kind = 'F') AS unique_people, CAST(NULL AS BIGINT) AS rank_values FROM ledger",
    part="evidence", operation="sum", target="support", filters=(where("kind", "eq", "F"),),
)

_GROUPS = "SELECT department, round(sum(support), 2) AS total, count(*) AS n_rows FROM ledger WHERE support IS NOT NULL GROUP BY department"
_money_total = lambda d: d.withColumn("total", cents("total"))
plan_query("group_sum_all", _GROUPS, _money_total, operation="group_sum", target="support", group_by=("department",))
_PEOPLE = "SELECT translate(person, 'Oo0xX', '*****') AS person, round(sum(amount), 2) AS total, count(*) AS n_rows, min(pos) AS f FROM ledger WHERE paid_on >= TIMESTAMP '1996-01-01' GROUP BY ALL"
plan_query("group_sum_top1", f"SELECT person, total, n_rows FROM ({_PEOPLE}) WHERE total = (SELECT max(total) FROM ({_PEOPLE}))", _money_total, operation="group_sum", target="amount", group_by=("person",), top_n=1, filters=(where("paid_on", "gte", "1996-01-01"),))
plan_query("group_sum_topn", f"SELECT person, total, n_rows FROM ({_PEOPLE}) ORDER BY total DESC, f LIMIT 10", _money_total, operation="group_sum", target="amount", group_by=("person",), top_n=10, filters=(where("paid_on", "gte", "1996-01-01"),))
plan_query("group_sum_rank", f"SELECT department, total, n_rows FROM (SELECT *, dense_rank() OVER (ORDER BY total DESC) AS r FROM ({_GROUPS})) WHERE r = 2", _money_total, operation="group_sum", target="support", group_by=("department",), rank_position=2)
plan_query("group_sum_two_keys", "SELECT department, kind, round(sum(amount), 2) AS total, count(*) AS n_rows FROM ledger GROUP BY department, kind", _money_total, operation="group_sum", target="amount", group_by=("department", "kind"), group_order="asc")


# People.
@register("per_capita", "SELECT round(avg(s), 4) AS per_capita, count(*) AS people FROM (SELECT sum(amount) AS s FROM ledger GROUP BY person)")
def _(spark, sf_dir):
    return identity.per_capita(ledger_frame(spark, sf_dir), F.col("person"), F.col("amount")).select(cents("per_capita", 4).alias("per_capita"), "people")


plan_query("per_person_mean", "SELECT round(avg(s), 4) AS value, count(*) AS people FROM (SELECT sum(amount) AS s FROM ledger GROUP BY person)", lambda d: d.select(cents("value", 4).alias("value"), "people"), operation="mean", target="amount", result_mode="per_person")


@register("person_total_top", "SELECT person, round(sum(amount), 2) AS total FROM ledger GROUP BY person ORDER BY sum(amount) DESC LIMIT 5")
def _(spark, sf_dir):
    return identity.person_extremes(ledger_frame(spark, sf_dir), F.col("person"), F.col("amount"), n=5).select("person", cents("total").alias("total"))


@register("person_total_min", "SELECT person, total FROM (SELECT person, round(sum(amount), 2) AS total, min(round(sum(amount), 2)) OVER () AS best FROM ledger GROUP BY person) WHERE total = best")
def _(spark, sf_dir):
    return identity.person_extremes(ledger_frame(spark, sf_dir), F.col("person"), F.col("amount"), descending=False).select("person", cents("total").alias("total"))


@register("row_extreme_subjects", "SELECT person, department, amount FROM ledger WHERE amount = (SELECT max(amount) FROM ledger)")
def _(spark, sf_dir):
    return identity.extreme_rows(ledger_frame(spark, sf_dir), F.col("amount"), ["person", "department"])


@register("count_people", "SELECT count(DISTINCT nullif(trim(memo), '')) AS people FROM ledger")
def _(spark, sf_dir):
    return identity.count_people(ledger_frame(spark, sf_dir), F.col("memo"))


#: Rows of 500 shared names, a phone for two in three and an e-mail for one in five customers.
SHARED_SQL = """WITH RECURSIVE rows_ AS (
  SELECT o_orderkey AS pos, o_totalprice AS amount, concat('고객', CAST(o_custkey % 300 AS VARCHAR)) AS person,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE concat('010-', CAST(o_custkey % 900 AS VARCHAR)) END AS phone,
    CASE WHEN o_orderkey % 5 = 0 THEN concat(CAST(o_custkey % 600 AS VARCHAR), '@x.kr') END AS email,
    CASE WHEN o_custkey % 2 = 0 THEN concat('k', CAST(o_custkey % 600 AS VARCHAR)) END AS cand
  FROM orders),
tokens AS (
  SELECT pos, concat(person, '|phone:', replace(phone, '-', '')) AS k FROM rows_ WHERE phone IS NOT NULL
  UNION SELECT pos, concat(person, '|email:', email) FROM rows_ WHERE email IS NOT NULL),
pairs AS (SELECT DISTINCT a.k AS x, b.k AS y FROM tokens a JOIN tokens b USING (pos)),
reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
first_of AS (SELECT k, min(pos) AS f FROM tokens GROUP BY k),
groups_ AS (SELECT t.pos, min(f.f) AS g FROM tokens t JOIN reach r ON t.k = r.x JOIN first_of f ON f.k = r.y GROUP BY t.pos),
placed AS (SELECT r.*, g FROM rows_ r LEFT JOIN groups_ USING (pos)),
per_key AS (SELECT person, cand, count(DISTINCT g) AS n, min(g) AS only_ FROM placed WHERE cand IS NOT NULL AND g IS NOT NULL GROUP BY ALL),
loose AS (SELECT person, cand, min(pos) AS l FROM placed WHERE cand IS NOT NULL AND g IS NULL GROUP BY ALL),
who AS (SELECT p.*, coalesce(p.g, CASE WHEN k.n = 1 THEN k.only_ END, l.l, p.pos) AS identity FROM placed p
  LEFT JOIN per_key k ON p.person = k.person AND p.cand = k.cand LEFT JOIN loose l ON p.person = l.person AND p.cand = l.cand)
"""


def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    number = lambda n: (F.col("o_custkey") % n).cast("string")
    return o.select(
        F.col("o_orderkey").alias(POSITION),
        F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("고객"), number(300)).alias("person"),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("010-"), number(900))).alias("phone"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(number(600), F.lit("@x.kr"))).alias("email"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("k"), number(600))).alias("_candidate_key"),
    )


@register("person_totals_components", SHARED_SQL + "SELECT translate(person, '0', '*') AS person, row_number() OVER (PARTITION BY person ORDER BY min(pos)) AS number, round(sum(amount), 2) AS total, count(amount) AS payments, min(pos) AS first_row FROM who GROUP BY person, identity", ledger_sql=False)
def _(spark, sf_dir):
    meanings = {"person": ColumnMeaning("entity", "person", "string"), "phone": ColumnMeaning(pii_type="phone"), "email": ColumnMeaning(pii_type="email"), "amount": ColumnMeaning("amount", "amount", "money", "KRW")}
    table = TableRef("df0", "people.xlsx", shared_names(spark, sf_dir), meanings)
    out = execute(QueryPlan(dataframe="df0", operation="sum", target="amount", result_mode="person_totals"), table).result
    return out.select("person", F.col("number").cast("long").alias("number"), cents("total").alias("total"), "payments", "first_row")


@register("person_cards", SHARED_SQL.replace("WITH RECURSIVE rows_", "WITH rows_").split("tokens AS")[0].rstrip().rstrip(",") + " SELECT person AS entity, (SELECT q.phone FROM rows_ q WHERE q.person = r.person AND q.phone IS NOT NULL ORDER BY q.pos LIMIT 1) AS phone, count(amount) AS payments, round(sum(amount), 2) AS total FROM rows_ r GROUP BY person", ledger_sql=False)
def _(spark, sf_dir):
    return identity.person_cards(shared_names(spark, sf_dir), F.col("person"), ["phone"], F.col("amount")).withColumn("total", cents("total"))


# Scalar functions.
MONEY_SQL = "SELECT pos, CASE WHEN pos % 17 = 0 THEN NULL WHEN pos % 5 = 0 THEN floor(amount) WHEN pos % 3 = 0 THEN -10000.0 * CAST(regexp_extract(amount_text, '\\d+') AS DOUBLE) ELSE floor(amount) END AS value FROM ledger"


@register("money_parse", MONEY_SQL)
def _(spark, sf_dir):
    return ledger_frame(spark, sf_dir).select(F.col(POSITION).alias("pos"), money(F.col("amount_text")).alias("value"))


@register("date_parse", "SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders", ledger_sql=False)
def _(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 11 == 0, "날짜오류").when(k % 5 == 0, F.date_format(d, "yyyy년 M월 d일")).when(k % 5 == 1, F.date_format(d, "yyyy.MM.dd")).when(k % 5 == 2, F.date_format(d, "yyyyMMdd")).when(k % 5 == 3, F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")).otherwise(F.date_format(d, "yyyy/M/d"))
    return read(spark, sf_dir, "orders").select(k.alias("pos"), dates.to_timestamp(text).cast("date").alias("day"))


#: Three-letter names made of the customer's number.
NAME_SQL = "concat(chr(CAST(44032 + c_custkey % 11172 AS INT)), chr(CAST(44032 + (c_custkey * 7) % 11172 AS INT)), chr(CAST(44032 + (c_custkey * 13) % 11172 AS INT)))"


def made_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a Korean name; ``F.chr`` stops at one byte, so code points go through UTF-16."""
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(F.lit(44032) + (F.col("c_custkey") * n) % 11172), 4, "0")), "UTF-16BE")
    return read(spark, sf_dir, "customer").withColumn("name", F.concat(letter(1), letter(7), letter(13))).withColumn(POSITION, F.col("c_custkey"))


@register("mask_pattern", f"SELECT c_custkey AS key, concat(left({NAME_SQL}, 1), '*', right({NAME_SQL}, 1)) AS mask, true AS masked, false AS plain FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    mask = names.mask_pattern(F.col("name"))
    return made_names(spark, sf_dir).select(F.col("c_custkey").alias("key"), mask.alias("mask"), names.is_masked(mask).alias("masked"), names.is_masked(F.col("name")).alias("plain"))


@register("norm_identifier", "SELECT c_custkey AS key, regexp_replace(upper(c_name), '[^0-9A-Z가-힣]', '', 'g') AS identifier FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), names.identifier(F.col("c_name")).alias("identifier"))


@register("cohort_key", "SELECT c_custkey AS key, CAST(c_nationkey AS VARCHAR) AS cohort FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), names.cohort(F.concat(F.lit("제"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit("회"))).alias("cohort"))


@register("stable_ids", "SELECT c_custkey AS key, concat('row_', substr(sha256(concat('customer::', CAST(c_custkey AS VARCHAR))), 1, 20)) AS id FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), names.stable_id("row", F.lit("customer"), F.col("c_custkey")).alias("id"))


# Dates.
_MONTHS = "SELECT count(*) AS n_rows, round(sum(amount), 2) AS total FROM ledger WHERE "
_month_sum = lambda d: d.agg(F.count("*").alias("n_rows"), F.round(F.sum("amount"), 2).alias("total"))


@register("month_range", _MONTHS + "y * 100 + m BETWEEN 199603 AND 199702")
def _(spark, sf_dir):
    return _month_sum(ledger_frame(spark, sf_dir).where(dates.timestamp_range(F.col("paid_on"), (1996, 3), (1997, 2))))


@register("month_all_years", _MONTHS + "m BETWEEN 3 AND 5")
def _(spark, sf_dir):
    d = F.col("paid_on")
    return _month_sum(ledger_frame(spark, sf_dir).where(dates.month_range(F.year(d), F.month(d), (None, 3), (None, 5))))


@register("month_components", _MONTHS + "y * 100 + m BETWEEN 199711 AND 199801")
def _(spark, sf_dir):
    frame = ledger_frame(spark, sf_dir).withColumns({"y": F.concat(F.year("paid_on").cast("string"), F.lit("년")), "m": F.concat(F.month("paid_on").cast("string"), F.lit("월"))})
    return _month_sum(frame.where(dates.month_range(dates.component(F.col("y")), dates.component(F.col("m")), (1997, 11), (1998, 1))))


# Comparisons. People pay where the amount is above zero, which holds for all rows but every ninth.
def roles() -> compare.Roles:
    return compare.Roles(F.col("person"), F.coalesce("support", F.lit(0.0)), F.year("paid_on"), F.month("paid_on"), F.col("department"))


PAID_SQL = LEDGER_SQL.rstrip() + ", paid AS (SELECT *, coalesce(support, 0) AS a FROM ledger), yp AS (SELECT person, round(sum(a) FILTER (y = 1996), 2) AS first_total, round(sum(a) FILTER (y = 1997), 2) AS second_total FROM paid WHERE a > 0 AND y IN (1996, 1997) GROUP BY person)\n"


def compare_query(name: str, sql: str, run: Callable[[DataFrame], DataFrame], money_columns: tuple[str, ...] = ()) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(ledger_frame(spark, sf_dir))
        return out.withColumns({c: cents(c) for c in money_columns})

    QUERIES[name], ORACLE[name] = f, PAID_SQL + sql


_both = ("first_total", "second_total")
compare_query("years_both", "SELECT person, first_total, second_total FROM yp WHERE first_total IS NOT NULL AND second_total IS NOT NULL", lambda d: compare.years_both(d, roles(), 1996, 1997), _both)
compare_query("years_later_only", "SELECT person, second_total FROM yp WHERE first_total IS NULL", lambda d: compare.years_later_only(d, roles(), 1996, 1997), ("second_total",))
compare_query("years_increased", "SELECT person, first_total, second_total FROM yp WHERE second_total > first_total", lambda d: compare.years_changed(d, roles(), 1996, 1997, True), _both)
compare_query("years_decreased", "SELECT person, first_total, second_total FROM yp WHERE second_total < first_total", lambda d: compare.years_changed(d, roles(), 1996, 1997, False), _both)
compare_query("years_count_diff", "SELECT count(first_total) AS first_people, count(second_total) AS second_people, count(second_total) - count(first_total) AS difference FROM yp", lambda d: compare.years_people_count(d, roles(), 1996, 1997))
compare_query("nonpayer", "SELECT person, first_total FROM yp WHERE first_total IS NOT NULL AND second_total IS NULL", lambda d: compare.nonpayers(d, roles(), 1996, 1997), ("first_total",))
_CHANGE = "SELECT round(f, 2) AS first_total, {0}, round(s, 2) AS second_total, {1}, round(s - f, 2) AS difference, round((s - f) * 100.0 / nullif(f, 0), 6) AS rate FROM "
_rate = lambda d: d.withColumns({"first_total": cents("first_total"), "second_total": cents("second_total"), "difference": cents("difference"), "rate": cents("rate", 6)})
compare_query("period_compare", _CHANGE.format("fp AS first_people", "sp AS second_people") + "(SELECT sum(a) FILTER (m = 1) AS f, count(DISTINCT person) FILTER (m = 1) AS fp, sum(a) FILTER (m = 2) AS s, count(DISTINCT person) FILTER (m = 2) AS sp FROM paid WHERE a > 0)", lambda d: _rate(compare.periods(d, roles(), F.month("paid_on") == 1, F.month("paid_on") == 2)))
compare_query("half_year", _CHANGE.format("fp AS first_people", "sp AS second_people") + "(SELECT sum(a) FILTER (m <= 6) AS f, count(DISTINCT person) FILTER (m <= 6) AS fp, sum(a) FILTER (m > 6) AS s, count(DISTINCT person) FILTER (m > 6) AS sp FROM paid WHERE a > 0)", lambda d: _rate(compare.half_years(d, roles())))
compare_query("group_payment_rate", 'SELECT department AS "group", count(DISTINCT person) AS people, count(DISTINCT person) FILTER (a > 0) AS paid_people, round(sum(a) FILTER (a > 0), 2) AS paid_total, round(count(DISTINCT person) FILTER (a > 0) * 100.0 / count(DISTINCT person), 6) AS rate FROM paid GROUP BY department', lambda d: compare.group_rates(d, roles()).withColumns({"paid_total": cents("paid_total"), "rate": cents("rate", 6)}))
compare_query("year_amount_compare", _CHANGE.format("fr AS first_rows", "sr AS second_rows") + "(SELECT sum(a) FILTER (y = 1996) AS f, count(*) FILTER (y = 1996) AS fr, sum(a) FILTER (y = 1997) AS s, count(*) FILTER (y = 1997) AS sr FROM paid)", lambda d: _rate(compare.year_amounts(d, roles(), 1996, 1997)))


def _extreme_sql(key: str, best: str, value: str = "round(sum(a), 2)", name: str = "total", more: str = ", count(*) AS n_rows", where_: str = "") -> str:
    return f"SELECT * EXCLUDE (best) FROM (SELECT {key} AS key, {value} AS {name}{more}, {best}({value}) OVER () AS best FROM paid {where_} GROUP BY {key}) WHERE {name} = best"


compare_query("extreme_year", _extreme_sql("y", "min"), lambda d: compare.extreme_total(d, roles(), F.year("paid_on").cast("long"), False), ("total",))
compare_query("extreme_month", _extreme_sql("m", "max"), lambda d: compare.extreme_total(d, roles(), F.month("paid_on").cast("long"), True), ("total",))
compare_query("extreme_group", _extreme_sql("department", "max"), lambda d: compare.extreme_total(d, roles(), F.col("department"), True), ("total",))
compare_query("extreme_period_count", _extreme_sql("m", "max", "count(*)", "n_rows", "", "WHERE a > 0"), lambda d: compare.extreme_count(d, roles(), F.month("paid_on").cast("long"), True, paid=True))
compare_query("most_frequent_person", "SELECT person, n_rows FROM (SELECT person, count(*) AS n_rows, max(count(*)) OVER () AS best FROM paid GROUP BY person) WHERE n_rows = best", lambda d: compare.most_frequent_person(d, roles()))
compare_query("least_frequent_payer", "SELECT person, n_rows FROM (SELECT person, count(*) AS n_rows, min(count(*)) OVER () AS best FROM paid WHERE a > 0 GROUP BY person) WHERE n_rows = best", lambda d: compare.most_frequent_person(d, roles(), descending=False, paid=True))
compare_query("max_min_diff", "SELECT max(amount) AS largest, min(amount) AS smallest, round(max(amount) - min(amount), 2) AS difference FROM ledger", lambda d: compare.extreme_difference(d, F.col("amount")), ("difference",))


# Unions, searches by name, cleaning.
@register("union_tables_dedup", "SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 3 < 2 THEN 0 ELSE 1 END AS part FROM orders", ledger_sql=False)
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderkey").alias(POSITION))
    a, b = (o.where(F.col("uid") % 3 < 2).withColumn("part", F.lit(0)), o.where(F.col("uid") % 3 > 0).withColumn("part", F.lit(1)).withColumn("extra", F.lit("x")))
    return identity.union_tables([a, b], "uid").select("uid", "part")


@register("name_search_class", f"SELECT c_custkey AS key, 0 AS match_class FROM customer WHERE {NAME_SQL} = (SELECT min({NAME_SQL}) FROM customer WHERE c_custkey = 7)", ledger_sql=False)
def _(spark, sf_dir):
    query = "".join(chr(44032 + 7 * n) for n in (1, 7, 13))
    return identity.name_search(made_names(spark, sf_dir), ["name"], query).select(F.col("c_custkey").alias("key"), "match_class")


@register("name_search_masked", f"SELECT c_custkey AS key, 2 AS match_class FROM customer WHERE concat(left({NAME_SQL}, 1), '*', right({NAME_SQL}, 1)) = '{chr(44032 + 7)}*{chr(44032 + 91)}'", ledger_sql=False)
def _(spark, sf_dir):
    query = "".join(chr(44032 + 7 * n) for n in (1, 7, 13))
    frame = made_names(spark, sf_dir).withColumn("masked", names.mask_pattern(F.col("name")))
    return identity.name_search(frame, ["masked"], query).select(F.col("c_custkey").alias("key"), "match_class")


_DISTANCE = f"abs(unicode(right({NAME_SQL}, 1)) - {44032 + 105})"


@register("nearest_masked", f"SELECT key, distance FROM (SELECT c_custkey AS key, CAST({_DISTANCE} AS INT) AS distance, min({_DISTANCE}) OVER () AS best FROM customer WHERE left({NAME_SQL}, 1) = '{chr(44032 + 7)}' AND {_DISTANCE} <= 180) WHERE distance = best", ledger_sql=False)
def _(spark, sf_dir):
    frame = made_names(spark, sf_dir).withColumn("masked", names.mask_pattern(F.col("name")))
    return identity.nearest_masked(frame, "masked", chr(44032 + 7) + "*" + chr(44032 + 105)).select(F.col("c_custkey").alias("key"), F.col("distance").cast("int").alias("distance"))


@register("cohort_filter", "SELECT c_custkey AS key FROM customer WHERE c_nationkey = 7 OR c_custkey % 50 = 3", ledger_sql=False)
def _(spark, sf_dir):
    frame = read(spark, sf_dir, "customer").withColumns({"cohort": F.concat(F.col("c_nationkey").cast("string"), F.lit("기")), "org": F.when(F.col("c_custkey") % 50 == 3, "동문회 7회").otherwise("17회")})
    return identity.cohort_filter(frame, "cohort", ["org"], "7").select(F.col("c_custkey").alias("key"))


@register("identifier_filter", "SELECT c_custkey AS key FROM customer WHERE c_custkey IN (12, 77)", ledger_sql=False)
def _(spark, sf_dir):
    return identity.identifier_filter(read(spark, sf_dir, "customer"), ["c_name"], ["customer 000000012", "Customer-000000077"]).select(F.col("c_custkey").alias("key"))


@register("organisation_search", "SELECT s_suppkey AS key, 1 AS match_rank FROM supplier WHERE s_suppkey = 5", ledger_sql=False)
def _(spark, sf_dir):
    return identity.organisation_search(read(spark, sf_dir, "supplier"), "s_name", "000000005").select(F.col("s_suppkey").alias("key"), "match_rank")


@register("known_people", "SELECT c_custkey AS key FROM customer WHERE c_custkey % 4 < 2", ledger_sql=False)
def _(spark, sf_dir):
    frame = read(spark, sf_dir, "customer").withColumn("kind", F.when(F.col("c_custkey") % 4 == 0, "person").when(F.col("c_custkey") % 4 == 1, "person_masked").when(F.col("c_custkey") % 4 == 2, "organization"))
    return identity.known_people(frame, "kind").select(F.col("c_custkey").alias("key"))


@register("drop_non_data_rows", "SELECT c_custkey AS key FROM customer WHERE c_custkey % 10 NOT IN (0, 1, 2, 3, 4)", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey") % 10
    note = "이 표는 내부 검토를 위하여 만든 자료입니다"
    a = F.when(k == 0, "").when(k == 1, note).when(k == 2, "합계").when(k == 3, "1,000").when(k == 4, "12명 × 100").otherwise(F.col("c_name"))
    b = F.when(k.isin(0, 1), None).when(k.isin(2, 3), "1,000").otherwise(F.col("c_custkey").cast("string"))
    frame = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_key"), F.col("c_custkey").alias(POSITION), a.alias("a"), b.alias("b"))
    return clean.drop_non_data(frame).select(F.col("_key").alias("key"))


@register("drop_repeated_tail", "SELECT c_custkey AS key FROM customer WHERE c_custkey <= (SELECT max(c_custkey) FROM customer) - 4", ledger_sql=False)
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    top = c.agg(F.max("c_custkey").alias("top"))
    frame = c.crossJoin(F.broadcast(top)).select(F.col("c_custkey").alias(POSITION), F.least(F.col("c_custkey"), F.col("top") - 4).alias("seq"))
    return clean.drop_repeated_tail(frame, "seq").select(F.col(POSITION).alias("key"))


@register("roster_expand", "SELECT n_nationkey AS key, CAST(i AS INT) AS entry, CAST(n_nationkey + 1 AS INT) AS class, CAST(i + 1 AS INT) AS seat, '홍길동' AS name FROM nation, range(3) t(i) WHERE i <= n_nationkey % 3", ledger_sql=False)
def _(spark, sf_dir):
    one = lambda i: F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(f"반 {i + 1}번 홍길동 "))
    frame = read(spark, sf_dir, "nation").withColumn("roster", F.concat(*(F.when(F.col("n_nationkey") % 3 >= i, one(i)).otherwise("") for i in range(3))))
    return clean.expand_roster(frame, "roster").select(F.col("n_nationkey").alias("key"), F.col("_entry").alias("entry"), "class", "seat", "name")


@register("entity_class", "SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'organization' WHEN 1 THEN 'department' WHEN 2 THEN 'person' ELSE 'person_masked' END AS kind FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey") % 4
    cell = F.when(k == 0, "주식회사 하나").when(k == 1, "경영학과").when(k == 2, F.col("name")).otherwise(F.concat(F.lit("49회 "), names.mask_pattern(F.col("name"))))
    return made_names(spark, sf_dir).select(F.col("c_custkey").alias("key"), names.entity(cell)["kind"].alias("kind"))


@register("schema_profile", "SELECT 'o_orderkey' AS column, least(100, count(*)) AS cells, 1.0::DOUBLE AS number_share, 0.0::DOUBLE AS date_share FROM orders UNION ALL SELECT 'o_orderdate', least(100, count(*)), 0.0, 1.0 FROM orders UNION ALL SELECT 'o_orderpriority', least(100, count(*)), 0.0, 0.0 FROM orders", ledger_sql=False)
def _(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    text = o.select(F.col("o_orderkey").alias(POSITION), F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    return schema.profile(text, ["o_orderkey", "o_orderdate", "o_orderpriority"]).select("column", "cells", F.col("number").alias("number_share"), F.col("date").alias("date_share"))


@register("summary", "SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS number, 3 AS month, 7600000 AS stated_amount FROM documents GROUP BY source", ledger_sql=False)
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("source", F.concat("source", F.lit(" 3월 -760만원.pdf")))
    return results.source_summary(docs, "source", "n_chars").withColumn("source", F.substring_index("source", " ", 1))


# Chunks, sections, retrieval.
@register("row_chunks", "SELECT c_custkey AS key, concat('[문서: ', c_mktsegment, '] / c_name: ', c_name, ' / c_nationkey: ', CAST(c_nationkey AS VARCHAR)) AS chunk_text FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    return retrieval.row_chunks(read(spark, sf_dir, "customer"), F.col("c_mktsegment"), ["c_name", "c_nationkey"]).select(F.col("c_custkey").alias("key"), "chunk_text")


@register("doc_overview", "SELECT source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY source", ledger_sql=False)
def _(spark, sf_dir):
    return retrieval.overview(read(spark, sf_dir, "documents"), F.col("source"), F.col("n_chars"))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.lit("conversations").alias("source"), F.col("conv_id").alias("section_id"), F.col("turn").alias("child_index"), "text")


@register("section_structure", "SELECT conv_id AS section_id, count(*) AS children, min(turn) AS first_child, max(turn) AS last_child, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id", ledger_sql=False)
def _(spark, sf_dir):
    return retrieval.structure(children(spark, sf_dir)).drop("source")


@register("section_read", "SELECT conv_id AS section_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id", ledger_sql=False)
def _(spark, sf_dir):
    return retrieval.read_sections(children(spark, sf_dir)).drop("source")


@register("section_expand", "WITH hits AS (SELECT conv_id, turn FROM conversations WHERE conv_id % 20 = 0), n AS (SELECT conv_id, count(*) AS k FROM conversations GROUP BY conv_id) SELECT DISTINCT c.conv_id AS section_id, c.turn AS child_index, c.text FROM conversations c JOIN hits h ON c.conv_id = h.conv_id JOIN n ON n.conv_id = c.conv_id WHERE n.k <= 4 OR abs(c.turn - h.turn) <= 1", ledger_sql=False)
def _(spark, sf_dir):
    c = children(spark, sf_dir)
    return retrieval.expand_sections(c.where(F.col("section_id") % 20 == 0), c).drop("source")


_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


def terms_sql(text: str) -> str:
    """The words of a text, by the rule of the documents' search: stop words out, then the longest particle and the ending cut, unless less than two letters stay."""
    stem = f"regexp_replace(regexp_replace(w, '({'|'.join(retrieval.WORD_PARTICLES)})$', ''), '({'|'.join(retrieval.WORD_ENDINGS)})$', '')"
    words = f"list_transform(regexp_extract_all({text}, '[가-힣A-Za-z0-9]{{2,}}'), lambda w: lower(w))"
    return f"list_distinct(list_transform(list_filter({words}, lambda w: w NOT IN ({_STOP})), lambda w: CASE WHEN length({stem}) >= 2 THEN {stem} ELSE w END))"


_TERMS = terms_sql("text")


@register("query_terms", f"SELECT item_id, list_sort({_TERMS}) AS terms FROM benchmark", ledger_sql=False)
def _(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.sort_array(retrieval.terms(F.col("text"))).alias("terms"))


_ENDED = [*retrieval.WORD_PARTICLES, *retrieval.WORD_ENDINGS, "", "하려면에서", "은는"]
_ASKS = ["알려줘", "어떻게", "신청하려면", "해야 하는", "가 있나"]
_QUESTION_SQL = "concat_ws(' ', concat('학과', c_custkey % 7, ([" + ", ".join(f"'{e}'" for e in _ENDED) + "])[c_custkey % " + str(len(_ENDED)) + " + 1]), c_mktsegment, concat('장학금', ([" + ", ".join(f"'{e}'" for e in _ENDED) + "])[c_nationkey % " + str(len(_ENDED)) + " + 1]), ([" + ", ".join(f"'{e}'" for e in _ASKS) + "])[c_custkey % 5 + 1])"


@register("question_terms", f"WITH q AS (SELECT c_custkey, {_QUESTION_SQL} AS text FROM customer) SELECT c_custkey, list_sort({terms_sql('text')}) AS terms FROM q", ledger_sql=False)
def _(spark, sf_dir):
    """Words of a question for each customer, with every particle and ending."""
    at = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))
    text = F.concat_ws(" ", F.concat(F.lit("학과"), (F.col("c_custkey") % 7).cast("string"), at(_ENDED, "c_custkey")), "c_mktsegment", F.concat(F.lit("장학금"), at(_ENDED, "c_nationkey")), at(_ASKS, "c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.sort_array(retrieval.terms(text)).alias("terms"))


_COS = "list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e)))"
_SCORES = "WITH v AS (SELECT vec_id, coalesce(label, -1) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query, e FROM v WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS chunk_id, label, round(" + _COS + ", 6) AS score FROM q, v)"
_TOP = _SCORES + ", top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 30)\n"


# Searches: every row whose id is divisible by 20, against all rows.
def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"), F.col("embedding").alias("vector"))


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.search(all_queries(spark, sf_dir), all_chunks(spark, sf_dir).withColumn("label", F.lit(0).cast("long")))
    return hits.select("query", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@register("vector_topk", _TOP + "SELECT query, chunk_id, score, rank FROM top", ledger_sql=False)
def _(spark, sf_dir):
    return all_hits(spark, sf_dir)


@register("relative_cut", _TOP + "SELECT query, chunk_id, score, rank FROM top t WHERE score >= (SELECT max(score) FROM top u WHERE u.query = t.query) - 0.18", ledger_sql=False)
def _(spark, sf_dir):
    return retrieval.relative_cut(all_hits(spark, sf_dir), "query").select("query", "chunk_id", "score", "rank")


@register("per_source_best", _SCORES + "SELECT query, label, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r = 1", ledger_sql=False)
def _(spark, sf_dir):
    return retrieval.search(all_queries(spark, sf_dir), all_chunks(spark, sf_dir), k=1).select("query", "label", "chunk_id", "score")


@register("merge_queries", _TOP + "SELECT chunk_id, max(score) AS score, list_sort(list(DISTINCT query)) AS queries FROM top GROUP BY chunk_id", ledger_sql=False)
def _(spark, sf_dir):
    return retrieval.merge_queries(all_hits(spark, sf_dir), "query")


@register("mmr")
def _(spark, sf_dir):
    return retrieval.mmr(all_hits(spark, sf_dir).join(all_chunks(spark, sf_dir).select("chunk_id", "vector"), "chunk_id"), "query")


@register("rerank")
def _(spark, sf_dir):
    """Texts are the documents of the same ids: the first line is a chunk's title and a query's question, its second line an expansion query."""
    line = lambda n: F.coalesce(F.try_element_at(F.split("text", r"\s*\n\s*"), F.lit(n)), F.lit(""))
    docs = read(spark, sf_dir, "documents")
    hits = written(all_hits(spark, sf_dir).drop("rank"), "hits")
    found_docs = docs.join(hits.select(F.col("chunk_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = found_docs.select(F.col("doc_id").alias("chunk_id"), retrieval.terms(F.col("text")).alias("text_terms"), retrieval.terms(line(1)).alias("title_terms"))
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), retrieval.terms(line(1)).alias("query_terms"), F.filter(F.array(retrieval.terms(line(2))), lambda q: F.size(q) > 0).alias("more_terms"))
    order = retrieval.mmr(hits.join(all_chunks(spark, sf_dir).select("chunk_id", "vector"), "chunk_id"), "query")
    found = hits.join(order, ["query", "chunk_id"], "left").join(texts, "chunk_id", "left").join(asked, "query", "left")
    none = F.array().cast("array<string>")
    found = found.withColumns({c: F.coalesce(c, none) for c in ("text_terms", "title_terms", "query_terms")} | {"more_terms": F.coalesce("more_terms", F.array().cast("array<array<string>>"))})
    # Only words that a query has count; the others needn't travel on.
    asked_for = F.concat("query_terms", F.flatten("more_terms"))
    titles = F.col("title_terms")
    found = found.withColumn("text_terms", F.array_intersect("text_terms", asked_for)).withColumn("title_terms", F.when(F.size(F.array_intersect(titles, asked_for)) > 0, F.array_intersect(titles, asked_for)).otherwise(F.slice(titles, 1, 1)))
    found = written(found, "candidates")
    # As candidates are found: within the relative cut of the question, or by words of a query.
    near = F.col("score") >= F.max("score").over(Window.partitionBy("query")) - retrieval.CUT
    own = (near | (retrieval.overlap(F.col("query_terms"), F.col("text_terms")) >= 0.4)).cast("int")
    more = F.size(F.filter("more_terms", lambda q: retrieval.overlap(q, F.col("text_terms")) >= 0.4))
    found = found.withColumn("queries", own + more).where("queries > 0").withColumns({"support": F.col("queries") / (1 + F.size("more_terms")), "mmr": F.coalesce(F.lit(1.0) / F.col("mmr_rank"), F.lit(0.0))})
    return retrieval.rerank(found, "query").withColumn("rank_score", F.round("rank_score", 6))


@register("lexical_overlap", f"WITH q AS (SELECT item_id, {_TERMS} AS qt FROM benchmark), d AS (SELECT doc_id, {_TERMS} AS dt FROM documents) SELECT item_id, doc_id, round(len(list_intersect(qt, dt)) / len(qt), 6) AS overlap FROM q, d WHERE len(qt) > 0 AND len(list_intersect(qt, dt)) / len(qt) >= 0.4", ledger_sql=False)
def _(spark, sf_dir):
    queries = read(spark, sf_dir, "benchmark").select("item_id", retrieval.terms(F.col("text")).alias("terms"))
    docs = read(spark, sf_dir, "documents").select("doc_id", retrieval.terms(F.col("text")).alias("terms"))
    return retrieval.overlaps(queries, docs, 0.4).withColumn("overlap", F.round("overlap", 6))


@register("chunk_split")
def _(spark, sf_dir):
    return retrieval.split_chunks(read(spark, sf_dir, "documents").select("doc_id", "text"))


@register("html_tables", "SELECT page_id, 0 AS table_index, CAST(r AS INT) AS row_index, CASE r WHEN 0 THEN ['번호', '값', '값'] WHEN 1 THEN ['번호', CAST(page_id AS VARCHAR), 'a & b'] ELSE [url, url, url] END AS cells FROM pages, range(3) t(r)", ledger_sql=False)
def _(spark, sf_dir):
    """Whole pages, each with a table whose spans and missing end tags must be read."""
    table = F.concat(F.lit("<table><tr><th rowspan=2>번호<th colspan=2>값</tr><tr><td>"), F.col("page_id").cast("string"), F.lit("<td>a &amp; b</tr><tr><td colspan=3>"), F.col("url"), F.lit("</table>"))
    return grids.page_tables(read(spark, sf_dir, "pages").withColumn("html", F.concat(F.regexp_replace("html", "</body>.*", ""), table, F.lit("</body></html>"))))


_LIMITS = "WITH c AS (SELECT conv_id * 1000 + turn AS chunk_id, concat('s', CAST(conv_id % 50 AS VARCHAR)) AS source, concat(text, CASE WHEN (conv_id + turn) % 2 = 0 THEN ' 장학금 신청이 제한됩니다' ELSE ' 안내문' END) AS text FROM conversations)"


@register("constraint_chunks", _LIMITS + " SELECT chunk_id FROM c WHERE regexp_matches(text, '제한|제외|불가|금지') AND (contains(lower(text), '장학금') OR contains(lower(text), '조건')) AND source IN (SELECT source FROM c WHERE chunk_id % 20 = 0) AND chunk_id % 20 <> 0", ledger_sql=False)
def _(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    text = F.concat("text", F.when((conv + turn) % 2 == 0, " 장학금 신청이 제한됩니다").otherwise(" 안내문"))
    c = read(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), (conv % 50).cast("string")).alias("source"), (conv * 1000 + turn).alias("chunk_id"), text.alias("text"))
    return retrieval.constraint_chunks(c, c.where(F.col("chunk_id") % 20 == 0), "장학금 조건").select("chunk_id")


@register("table_fields", "SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    chunk = retrieval.row_chunks(read(spark, sf_dir, "customer"), F.lit("고객"), ["c_name", "c_nationkey"])
    m = retrieval.table_fields(F.col("chunk_text"))
    return chunk.select(F.col("c_custkey").alias("key"), m["c_name"].alias("name"), m["c_nationkey"].alias("nation"))


@register("numeric_criteria", "SELECT c_custkey AS key, CAST(c_custkey AS DOUBLE) AS value, CASE WHEN c_custkey % 2 = 0 THEN 'gte' ELSE 'lt' END AS operator FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    text = F.concat(F.lit("평점 "), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "점 이상인 자").otherwise("점 미만"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.explode(retrieval.numeric_criteria(text)).alias("c")).select("key", "c.value", "c.operator")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice for each customer, its numbers made of the key."""
    k = F.col("c_custkey")
    text = F.concat(F.lit("사업: 사업"), k.cast("string"), F.lit(" / 담당부서: 부서"), (k % 7).cast("string"), F.lit(" / 예산: "), (k * 1000).cast("string"), F.lit("원 / 접수기간: "), (k % 12 + 1).cast("string"), F.lit("월"))
    lines = F.concat(F.lit("- 선발인원: "), (k % 9 + 1).cast("string"), F.lit("명\n재학생을 우선 선발한다. 잔여 인원은 추첨한다.\n"), F.when(k % 2 == 0, F.lit("휴학생은 제외한다.")).otherwise("다자녀 가구를 우대한다."))
    return read(spark, sf_dir, "customer").select(k.alias("chunk_id"), text.alias("row_text"), lines.alias("text"))


@register("responsible_party", "SELECT c_custkey AS chunk_id, concat('부서', CAST(c_custkey % 7 AS VARCHAR)) AS value FROM customer WHERE c_custkey = 42", ledger_sql=False)
def _(spark, sf_dir):
    rows = notices(spark, sf_dir).select("chunk_id", F.col("row_text").alias("text"))
    return evidence.responsible_party(rows, "사업42 담당은 어디인가요").select("chunk_id", "value")


@register("period_field", "SELECT c_custkey AS chunk_id, concat(CAST(c_custkey % 12 + 1 AS VARCHAR), '월') AS value FROM customer WHERE c_custkey = 42", ledger_sql=False)
def _(spark, sf_dir):
    rows = notices(spark, sf_dir).select("chunk_id", F.col("row_text").alias("text"))
    return evidence.period(rows, "사업42 접수는 언제").select("chunk_id", "value")


@register("total_difference", "SELECT CAST(42000 AS DOUBLE) AS first, CAST(77000 AS DOUBLE) AS second, CAST(-35000 AS DOUBLE) AS difference", ledger_sql=False)
def _(spark, sf_dir):
    rows = notices(spark, sf_dir).select("chunk_id", F.col("row_text").alias("text"))
    return evidence.total_difference(rows, "사업: 사업42 /", "사업: 사업77 /", "예산")


@register("scalar_fields", "SELECT c_custkey AS chunk_id, '선발인원' AS label, concat(CAST(c_custkey % 9 + 1 AS VARCHAR), '명') AS value FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    return evidence.scalar_fields(notices(spark, sf_dir), "people").withColumn("label", F.regexp_replace("label", "^- ", ""))


@register("exclusion_clauses", "SELECT c_custkey AS chunk_id, '휴학생은 제외한다.' AS clause FROM customer WHERE c_custkey % 2 = 0", ledger_sql=False)
def _(spark, sf_dir):
    return evidence.clauses(notices(spark, sf_dir), "exclusion")


@register("priority_clauses", "SELECT c_custkey AS chunk_id, '재학생을 우선 선발한다' AS priority, '잔여 인원은 추첨한다' AS remainder FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    return evidence.priority_then_rest(notices(spark, sf_dir))


@register("criteria_met", "SELECT c_custkey AS chunk_id, CAST(c_custkey AS DOUBLE) AS value, CASE WHEN c_custkey % 2 = 0 THEN 'gte' ELSE 'lt' END AS operator, CASE WHEN c_custkey % 2 = 0 THEN 50 >= c_custkey ELSE 50 < c_custkey END AS met FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    text = F.concat(F.lit("평점 "), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, "점 이상인 자").otherwise("점 미만"))
    return evidence.criteria_met(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), text.alias("text")), 50)


@register("missing_items", "SELECT c_custkey AS chunk_id, '둘째 항목' AS item FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    chunks = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), F.lit("1. 첫째 항목\n2. 둘째 항목").alias("text"))
    return evidence.missing_items(chunks, "첫째 항목만 있습니다")


# Manifest.
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source"), F.col("event_id").alias("at"), F.col("event_type").alias("file_hash"), F.when(F.col("event_id") % 4 == 0, "FAILED").otherwise("SUCCESS").alias("status"), F.lit("2.4").alias("schema_version"))


_LATEST = "WITH latest AS (SELECT concat('f', CAST(user_id AS VARCHAR)) AS source, event_id AS at, event_type AS file_hash, CASE WHEN event_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)\n"


@register("manifest_latest", _LATEST + "SELECT * FROM latest", ledger_sql=False)
def _(spark, sf_dir):
    return catalog.latest(_log(spark, sf_dir), "source", "at").select("source", "at", "file_hash", "status")


@register("manifest_pending", _LATEST + "SELECT source, 'click' AS file_hash FROM latest WHERE NOT (file_hash = 'click' AND status = 'SUCCESS')", ledger_sql=False)
def _(spark, sf_dir):
    now = catalog.latest(_log(spark, sf_dir), "source", "at")
    return catalog.pending(now.select("source", F.lit("click").alias("file_hash")), now, "2.4")
