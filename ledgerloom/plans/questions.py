"""Questions turned into plans: intents, guards, routes, and plans grounded in a table's columns and values.

Everything here runs on the driver over short texts; only lookups of stored values are Spark jobs.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from ledgerloom.functions.names import is_masked, person_name
from ledgerloom.operators.cellindex import CellIndex, plain
from ledgerloom.operators.schema import amount_column, date_column
from ledgerloom.operators.scope import Notice, Span, dated_rows
from ledgerloom.plans.execute import typed
from ledgerloom.plans.model import FilterCondition, QueryPlan, SortCondition
from ledgerloom.plans.table import ColumnMeaning, TableRef
from ledgerloom.plans.validate import comparisons

# Words of questions.
ORDINALS = {"첫": 1, "두": 2, "세": 3, "네": 4, "다섯": 5, "여섯": 6, "일곱": 7, "여덟": 8, "아홉": 9, "열": 10}
COUNT, MEDIAN, MODE, PER_CAPITA = r"몇\s*(?:명|건|개|번)|인원|건수|수는|명수|개수", r"중앙값|중간값", r"최빈값|가장\s*(?:흔한|자주)", r"1인당|인당|한\s*사람당"
MEAN, MAX, MIN, SUM = r"평균", r"최대|최고|가장\s*(?:많|큰|높)|제일\s*(?:많|큰|높)", r"최소|최저|가장\s*(?:적|작|낮)|제일\s*(?:적|작|낮)", r"합계|총액|총합|누적|모두\s*더|전체\s*금액"
VECTOR = r"설명|요약|절차|방법|기준|조건|대상|이유|무엇|규정|안내|신청"
LISTING = r"목록|명단|보여|알려|조회|리스트|누구"
DOCUMENTS = r"문서\s*(?:목록|리스트)|어떤\s*문서|자료\s*목록"
VAGUE = ("알려줘", "보여줘", "조회", "뭐야", "설명해줘", "요약해줘", "요약", "정리")
PAIR = r"((?:20|19)\d{2})\s*년?(?:도)?.*?((?:20|19)\d{2})\s*년?"


@dataclass(frozen=True)
class Intent:
    operation: str
    target: str = "amount"
    top_n: int | None = None


@dataclass(frozen=True)
class MonthRange:
    start: tuple[int | None, int]
    end: tuple[int | None, int]
    all_years: bool
    text: str


@dataclass(frozen=True)
class Clarification:
    code: str
    message: str
    candidates: tuple[str, ...] = ()


def top_n(question: str) -> int | None:
    m = re.search(r"(?:상위|하위|top)\s*(\d{1,3})|(\d{1,3})\s*(?:명|건|개|위)\s*까지", question, re.I)
    return int(m[1] or m[2]) if m else None


def rank_position(question: str) -> int | None:
    """``3번째``, ``셋째``, ``두 번째`` and the like."""
    m = re.search(r"(\d{1,3})\s*(?:번째|째|위|등)(?!\s*까지)", question)
    if m:
        return int(m[1])
    m = re.search(rf"({'|'.join(ORDINALS)})\s*번째", question)
    return ORDINALS[m[1]] if m else None


def intents(question: str) -> list[Intent]:
    """Aggregations that a question asks for, in order of precedence."""
    has = lambda p: re.search(p, question) is not None
    person = has(r"사람|누구|명단|학생|기부자|회원") and not has(r"한\s*번에|한\s*건")
    out = []
    if has(COUNT):
        out.append(Intent("count", "people" if has(r"몇\s*명|인원|명수") else "rows"))
    if has(MEDIAN):
        out.append(Intent("median"))
    if has(MODE):
        out.append(Intent("mode"))
    if has(PER_CAPITA):
        out.append(Intent("per_capita"))
    elif has(MEAN):
        out.append(Intent("mean"))
    if has(MAX) and not has(MODE):
        out.append(Intent("max", "person" if person else "amount", top_n(question)))
    if has(MIN):
        out.append(Intent("min", "person" if person else "amount", top_n(question)))
    if has(SUM) and not (has(r"누적") and (has(MAX) or has(MIN))):
        out.append(Intent("sum"))
    return out


def month_range(question: str) -> MonthRange | Clarification | None:
    """Months that a question names; reversed ranges are refused."""
    month = r"(?:((?:20|19)\d{2})\s*년\s*)?(\d{1,2})\s*월"
    m = re.search(rf"{month}\s*(?:부터|에서|~|-|–)\s*{month}", question)
    every = re.search(r"모든\s*(?:연도|해)|매년|연도\s*무관", question) is not None
    if m:
        y1 = int(m[1]) if m[1] else None
        y2 = int(m[3]) if m[3] else y1
        start, end = (y1 or y2, int(m[2])), (y2, int(m[4]))
    else:
        m = re.search(month, question)
        if not m:
            return None
        start = end = (int(m[1]) if m[1] else None, int(m[2]))
    if not (1 <= start[1] <= 12 and 1 <= end[1] <= 12):
        return Clarification("month", "달은 1월에서 12월 사이여야 합니다")
    if (start[0] or 0, start[1]) > (end[0] or 0, end[1]):
        return Clarification("reversed_range", "기간의 앞뒤가 바뀌었습니다")
    return MonthRange(start, end, every, m[0])


def guard(question: str) -> Clarification | None:
    """Questions that can't be answered as they stand."""
    q = question.strip()
    if not q:
        return Clarification("empty", "질문을 입력해 주세요")
    if len(re.sub(r"\W", "", q)) <= 1:
        return Clarification("meaningless", "질문을 조금 더 적어 주세요")
    if not re.search(r"[가-힣A-Za-z]{2,}|\d", q) or re.fullmatch(r"(.)\1{2,}|[ㄱ-ㅎㅏ-ㅣ\s]+", q):
        return Clarification("meaningless", "질문을 알아볼 수 없습니다")
    if q.rstrip("?!. ") in VAGUE:
        return Clarification("vague", "무엇을 알고 싶은지 적어 주세요")
    several = {i.operation for i in intents(q)} - {"count"}
    if len(several) > 1 and several != {"max", "min"}:
        return Clarification("several_operations", "한 번에 한 가지 계산만 물어봐 주세요", tuple(sorted(several)))
    return None


def route(question: str) -> str:
    """``documents``, ``table`` or ``text``."""
    if re.search(DOCUMENTS, question):
        return "documents"
    if intents(question) or comparisons(question) or re.search(r"\d\s*월|\d{1,3}\s*(?:회|기)(?!\w)", question):
        return "table"
    if re.search(VECTOR, question):
        return "text"
    return "table" if re.search(LISTING, question) else "text"


def normal(value) -> str:
    return re.sub(r"[\W_]", "", unicodedata.normalize("NFKC", str(value)).casefold())


def requested_columns(meanings: dict[str, ColumnMeaning], question: str) -> list[str]:
    """Columns whose header the question writes out."""
    q = normal(question)
    return [c for c in meanings if len(normal(c)) >= 2 and normal(c) in q]


def value_filters(table: TableRef, question: str, index: CellIndex | None = None) -> list[FilterCondition]:
    """``column = value`` where exactly one stored value of a text column occurs in the question.

    Stored values are compared with the question in Spark, so only those that it holds come back, however many there are: in one scan for all columns, or
    by the tables' ``index``, which reads no table.
    """
    q = normal(question)
    columns = [c for c in table.visible if (m := table.meaning(c)).data_type == "string" and not m.is_person and m.role not in ("note", "identifier", "email", "phone")]
    if not columns:
        return []
    if index is not None:
        held: dict[str, set[str]] = {}
        for r in index.values_in(q, table.alias).collect():
            held.setdefault(r["column"], set()).add(r["value"].strip(" "))
        found = [held.get(c, ()) for c in columns]
    else:
        fits = [F.collect_set(F.when((F.length(plain(F.col(f"`{c}`"))) >= 2) & F.contains(F.lit(q), plain(F.col(f"`{c}`"))), F.trim(f"`{c}`"))).alias(f"v{i}") for i, c in enumerate(columns)]
        found = table.frame.agg(*fits).collect()[0]
    out = []
    for c, values in zip(columns, found, strict=True):
        longest = [v for v in values if not any(v != w and normal(v) in normal(w) for w in values)]
        if len(longest) == 1:
            out.append(FilterCondition(c, "eq", longest[0]))
    return out


def person_filter(table: TableRef, question: str) -> FilterCondition | Clarification | None:
    """The person a question names: a stored name, or a masked one that it fits; it must be the only one.

    Only names that fit a stretch of the question come back, so there are no more than it has stretches.
    """
    if not table.people:
        return None
    c = table.people[0]
    name = person_name(F.col(f"`{c}`"))
    q = re.sub(r"\s", "", question)
    pattern = F.regexp_replace(name, r"\*", "[가-힣*]")
    fits = F.contains(F.lit(q), name) | (is_masked(name) & F.rlike(F.lit(q), pattern))
    held = [r[0] for r in table.frame.select(name.alias("n")).where((F.length("n") >= 2) & F.expr("n rlike '[가-힣]'") & fits).distinct().collect()]
    exact = [n for n in held if n in q]
    longest = [n for n in exact or held if not any(n != w and n in w for w in exact or held)]
    if len(longest) > 1:
        return Clarification("ambiguous_person", "여러 사람이 해당합니다", tuple(sorted(longest)))
    return FilterCondition(c, "eq", longest[0]) if longest else None


def comparison_filters(table: TableRef, question: str, amount: str | None) -> list[FilterCondition]:
    out = []
    for c in comparisons(question):
        role = next((r for w, r in (("기수", "cohort"), ("회차", "cohort"), ("연도", "year")) if w in question), None)
        column = amount if c.is_money else next((n for n in table.visible if table.meaning(n).role == role), None) or amount
        if column:
            unit = {"KRW_10000": 10_000, "KRW_1000": 1_000}.get(table.meaning(column).unit or "", 1)
            out.append(FilterCondition(column, c.operator, c.value / unit if c.is_money and table.meaning(column).data_type == "money" else c.value, source_text=c.text))
    return out


def plan(table: TableRef, question: str, index: CellIndex | None = None) -> QueryPlan:
    """A plan for a question about one table, or a plan that asks back."""
    ask = lambda code, message, found=(): QueryPlan(status="clarification", message=f"{code}: {message}", candidates=tuple(found)[:20])
    stop = guard(question)
    if stop:
        return ask(stop.code, stop.message, stop.candidates)
    meanings = {c: table.meaning(c) for c in table.visible}
    wanted = intents(question)
    amount, amounts = amount_column(meanings, question)
    if amount is None and len(amounts) > 1 and any(i.target == "amount" and i.operation != "count" for i in wanted):
        return ask("amount_column", "금액 열이 여러 개입니다", amounts)
    filters: list[FilterCondition] = comparison_filters(table, question, amount)
    span = month_range(question)
    if isinstance(span, Clarification):
        return ask(span.code, span.message)
    rest = question
    if span:
        rest = question.replace(span.text, " ")
        found = date_column(table.frame, meanings, question, None if span.start[0] is None else (span.start[0] * 100 + span.start[1], span.end[0] * 100 + span.end[1]))
        if found is None:
            return ask("date_column", "날짜 열을 정할 수 없습니다", [c for c, m in meanings.items() if m.data_type == "date"])
        if span.start[0] is None:
            year = None if span.all_years else only_year(table, found)
            if year is None:
                return ask("year", "연도를 함께 적어 주세요")
            span = MonthRange((year, span.start[1]), (year, span.end[1]), False, span.text)
        after = (span.end[0] + span.end[1] // 12, span.end[1] % 12 + 1)
        filters += [FilterCondition(found, "gte", f"{span.start[0]}-{span.start[1]:02d}-01"), FilterCondition(found, "lt", f"{after[0]}-{after[1]:02d}-01")]
    person = person_filter(table, rest)
    if isinstance(person, Clarification):
        return ask(person.code, person.message, person.candidates)
    filters += ([person] if person else []) + value_filters(table, rest, index)
    cohort = next((c for c, m in meanings.items() if m.role == "cohort"), None)
    m = re.search(r"(?<!\d)(\d{1,3})\s*(?:회|기)(?!\d)", rest)
    if m and cohort:
        filters.append(FilterCondition(cohort, "eq", int(m[1]) if meanings[cohort].data_type == "number" else m[1]))
    base = {"dataframe": table.alias, "filters": tuple(filters)}
    columns = [c for c in requested_columns(meanings, question) if c not in {f.column for f in filters}]
    rank, n = rank_position(question), top_n(question)
    person_column = table.people[0] if table.people else None
    group = next((c for c, mm in meanings.items() if mm.role in ("department", "cohort", "organization", "field") and re.search(rf"{re.escape(c)}\s*(?:별|마다)", question)), None)
    if amount and group:
        return QueryPlan(operation="group_sum", target=amount, group_by=(group,), top_n=n, rank_position=None if n else rank, **base)
    if not wanted:
        if rank and amount:
            return QueryPlan(operation="list", sort=(SortCondition(amount, "desc"),), rank_position=rank, **base)
        return QueryPlan(operation="list", select=tuple(columns), limit=n, **base)
    intent = wanted[0]
    if intent.operation == "count":
        return QueryPlan(operation="count", distinct_by=(person_column,) if intent.target == "people" and person_column else (), **base)
    if amount is None:
        return ask("amount_column", "금액 열이 없습니다")
    if intent.operation in ("max", "min"):
        order = "desc" if intent.operation == "max" else "asc"
        if intent.target == "person" and person_column:
            return QueryPlan(operation="group_sum", target=amount, group_by=(person_column,), group_order=order, top_n=None if rank else intent.top_n or 1, rank_position=rank, **base)
        if rank:
            return QueryPlan(operation="list", sort=(SortCondition(amount, order),), rank_position=rank, **base)
        return QueryPlan(operation=intent.operation, target=amount, result_mode="records", top_n=intent.top_n, **base)
    if intent.operation == "sum" and person:
        return QueryPlan(operation="sum", target=amount, result_mode="person_totals", **base)
    if intent.operation == "per_capita" and person_column:
        return QueryPlan(operation="mean", target=amount, result_mode="per_person", **base)
    return QueryPlan(operation="mean" if intent.operation == "per_capita" else intent.operation, target=amount, **base)


def only_year(table: TableRef, column: str) -> int | None:
    """The year of a date column whose dates are all of one year."""
    low, high = table.frame.select(F.year(typed(table, column)).alias("y")).agg(F.min("y"), F.max("y")).collect()[0]
    return low if low == high else None


def plan_dated(table: TableRef, question: str) -> tuple[QueryPlan, TableRef]:
    """A plan and the table it runs on: months of all years, which no filter of a plan says, narrow the table itself."""
    span = month_range(question)
    if not isinstance(span, MonthRange) or span.start[0] is not None or not span.all_years:
        return plan(table, question), table
    narrowed = dated_rows(table, Span(span.start, span.end, True), question)
    if isinstance(narrowed, Notice):
        return QueryPlan(status="clarification", message=f"date_column: {narrowed.message}"), table
    rest = re.sub(r"모든\s*(?:연도|해)(?:의)?|매년|연도\s*무관", " ", question.replace(span.text, " "))
    return plan(replace(table, frame=narrowed[0]), rest), replace(table, frame=narrowed[0])


def person_suggestions(table: TableRef, prefix: str, limit: int = 10) -> list[str]:
    """Stored names that begin with a prefix of two letters or more, or masked ones that may."""
    if len(prefix.strip()) < 2 or not table.people:
        return []
    name = person_name(F.col(f"`{table.people[0]}`"))
    p = re.sub(r"\s", "", prefix)
    masked = is_masked(name) & F.rlike(F.lit(p), F.concat(F.lit("^"), F.regexp_replace(F.left(name, F.lit(len(p))), r"\*", "[가-힣*]"), F.lit("$")))
    return [r[0] for r in table.frame.select(name.alias("n")).where(F.startswith("n", F.lit(p)) | masked).distinct().orderBy("n").limit(limit).collect()]


TEMPLATES = ("{amount} 합계", "{amount} 평균", "{amount}이 가장 많은 사람", "{group}별 {amount} 합계", "인원은 몇 명")


def suggestions(table: TableRef, typed: str = "", limit: int = 8) -> list[str]:
    """Questions that compile to a plan for this table and go on from what has been typed."""
    meanings = {c: table.meaning(c) for c in table.visible}
    amount = next((c for c, m in meanings.items() if m.data_type == "money"), None)
    group = next((c for c, m in meanings.items() if m.role in ("department", "cohort", "field")), None)
    out = [t.format(amount=amount, group=group) for t in TEMPLATES if (amount or "{amount}" not in t) and (group or "{group}" not in t)]
    return [q for q in out if normal(typed) in normal(q) and plan(table, q).status == "ready"][:limit]


def log_metadata(question: str) -> dict:
    """What may be logged of a question."""
    return {"question_hash": hashlib.sha256(question.encode()).hexdigest()[:12], "length": len(question)}
