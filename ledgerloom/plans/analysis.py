"""What a question asks for: operations, engines, the decision contract, and plans brought into line with the question.

A language model may decide or plan through adapters that hand over JSON; everything here runs on the driver over short texts, but for lookups of stored names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import is_masked, is_person, person_name
from ledgerloom.operators.cellindex import BEGINS, CellIndex, plain
from ledgerloom.operators.scope import NO_VALUES, Tables, cell_conditions, scanned_cells, tables_by_label
from ledgerloom.plans.model import FilterCondition, PlanError, QueryPlan
from ledgerloom.plans.questions import Clarification, Intent, MonthRange, guard, intents, month_range, normal, requested_columns
from ledgerloom.plans.table import NUMERIC, POSITION, TableRef
from ledgerloom.plans.validate import Issue, comparisons

# Operations of questions, the engines that answer them, and their words.
TABLE_OPERATIONS = (
    "compare", "max_person_by_amount", "min_person_by_amount", "list_records", "filter_records", "count_records", "sum_amount", "average_amount", "median_amount", "mode_amount", "max_amount", "min_amount", "lookup_amount", "lookup_field", "structured_query",
)
TEXT_OPERATIONS = ("document_reason", "document_purpose", "document_criteria", "document_procedure", "document_explain")
OPERATIONS = ("list_documents", *TABLE_OPERATIONS, *TEXT_OPERATIONS)
OF_INTENT = {"count": "count_records", "sum": "sum_amount", "mean": "average_amount", "per_capita": "average_amount", "median": "median_amount", "mode": "mode_amount", "max": "max_amount", "min": "min_amount"}
WORDS = {
    "list_documents": r"문서\s*(?:목록|리스트)|어떤\s*문서|자료\s*목록",
    "compare": r"비교|차이|대비|보다\s*(?:많|적|크|작)",
    "list_records": r"목록|명단|리스트|보여\s*줘|조회",
    "lookup_amount": r"얼마|금액|총액|지급액|출연금|장학금액|지원금",
    "document_reason": r"왜|이유|사유|원인",
    "document_purpose": r"목적|취지|용도",
    "document_criteria": r"기준|조건|자격|요건|규정",
    "document_procedure": r"절차|방법|신청|서류|접수",
    "document_explain": r"설명|요약|어떤\s*내용",
}
SUMMED = ("sum_amount", "average_amount", "median_amount", "mode_amount", "max_amount", "min_amount")
SEVERAL = r"그리고|하고\s|와\s*함께|및\s|또한|동시에"
MEANINGLESS = ("어이", "어어", "야", "음", "흠", "엥", "뭐", "하이", "안녕", "오케이", "test", "asdf")
MEANINGFUL = (
    "장학|지원금|기부|후원|출연|예산|집행|지급|수혜|금액|총액|합계|평균|명단|목록|인원|기수|발행번호|기준|조건|목적|이유|절차|규정|내용|누구|누가|얼마|중앙값|최빈값|비교|차이|조회|설명"
)
#: Letters of the longest input that may be no question at all.
SHORT = 12
MOST_REQUESTS, MOST_NAMES = 5, 500


@dataclass(frozen=True)
class Analysis:
    """Everything that a question says by its words alone."""

    question: str
    operations: tuple[str, ...]
    intents: tuple[Intent, ...]
    months: MonthRange | Clarification | None
    several: bool
    stop: Clarification | None

    @property
    def engines(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(engine_of(o) for o in self.operations))


def engine_of(operation: str) -> str:
    return "documents" if operation == "list_documents" else "text" if operation in TEXT_OPERATIONS else "table"


def operations(question: str, found: list[Intent]) -> list[str]:
    """Operations in the order in which they are looked for; a comparison stands for the calculations in it."""
    says = lambda name: re.search(WORDS[name], question) is not None
    out = ["list_documents"] if says("list_documents") else []
    if says("compare"):
        out.append("compare")
    else:
        if says("list_records") and not out:
            out.append("list_records")
        for intent in found:
            person = intent.operation in ("max", "min") and intent.target == "person"
            out.append(f"{intent.operation}_person_by_amount" if person else OF_INTENT[intent.operation])
        if says("lookup_amount") and not set(out) & {*SUMMED, "max_person_by_amount", "min_person_by_amount"}:
            out.append("lookup_amount")
    return list(dict.fromkeys([*out, *(o for o in TEXT_OPERATIONS if says(o))]))


def says_nothing(question: str) -> bool:
    """Whether a short input is only greetings and sounds, loose letters, or one short Latin word."""
    letters = re.sub(r"[\s!?~.,]+", "", question.lower())
    if not letters or len(letters) > SHORT or re.search(MEANINGFUL, question):
        return False
    words = re.findall(r"[^\W\d_]+", question.lower())
    sounds = lambda w: w in MEANINGLESS or re.fullmatch("[ㄱ-ㅎㅏ-ㅣ]+", w)
    return bool(re.fullmatch("[a-z]{1,8}|[ㄱ-ㅎㅏ-ㅣ]+", letters)) or letters in MEANINGLESS or bool(words) and all(map(sounds, words))


def analyse(question: str) -> Analysis:
    q = re.sub(r"\s+", " ", question.strip())
    found = intents(q)
    months = month_range(q)
    asked = operations(q, found)
    if isinstance(months, MonthRange) and not asked:
        asked = ["filter_records"]
    stop = guard(q) or (Clarification("meaningless", "질문을 알아볼 수 없습니다") if says_nothing(q) else None)
    return Analysis(q, tuple(asked), tuple(found), months, re.search(SEVERAL, q) is not None, stop)


def route_of(analysis: Analysis) -> str:
    """The engine of a question, or ``guide`` where its operations need several."""
    engines = analysis.engines
    return "text" if not engines else engines[0] if len(engines) == 1 else "guide"


class DecisionError(ValueError):
    """A decision that breaks its contract."""


@dataclass(frozen=True)
class Decision:
    """What a question is about, as a model or the words decide it: ``ready`` with operations, or a message."""

    status: str
    reason: str
    operations: tuple[str, ...] = ()
    requests: tuple[tuple[str, str], ...] = ()
    retrieval_query: str | None = None
    message: str | None = None
    candidates: tuple[str, ...] = ()

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise DecisionError(what)

        if self.requests and not self.operations:
            object.__setattr__(self, "operations", tuple(dict.fromkeys(o for _, o in self.requests)))
        need(self.status in ("ready", "clarification", "not_applicable"), f"unknown status {self.status!r}")
        need(0 < len(self.reason) <= 500, "a decision needs a reason of at most 500 letters")
        need(len(self.requests) <= MOST_REQUESTS and len(self.operations) <= MOST_REQUESTS and len(self.candidates) <= 10, "too many requests or candidates")
        need(set(self.operations) <= set(OPERATIONS), "unknown operation")
        if self.status != "ready":
            need(not self.operations and not self.requests and self.retrieval_query is None, f"{self.status} must not ask for anything")
            need(bool(self.message), f"{self.status} needs a message")
            return
        need(bool(self.operations) and len(set(self.operations)) == len(self.operations), "ready needs operations, each once")
        need(not self.requests or tuple(dict.fromkeys(o for _, o in self.requests)) == self.operations, "operations must be those of the requests")
        need((self.retrieval_query is not None) == bool(set(self.operations) & set(TEXT_OPERATIONS)), "a retrieval query belongs to document operations")
        need(self.message is None and not self.candidates, "ready must not ask back")

    @staticmethod
    def from_json(text: str | dict) -> Decision:
        raw = dict(json.loads(text) if isinstance(text, str) else text)
        known = set(Decision.__dataclass_fields__)
        if extra := set(raw) - known:
            raise DecisionError(f"unknown fields: {', '.join(sorted(extra))}")
        raw["requests"] = tuple((r["source_text"], r["operation"]) for r in raw.get("requests") or ())
        raw["operations"], raw["candidates"] = tuple(raw.get("operations") or ()), tuple(raw.get("candidates") or ())
        return Decision(**raw)


def decide(question: str, model: Callable[[str], str] | None = None) -> Decision:
    """The decision of a model, asked once more with the error if its answer breaks the contract; without one, that of the words."""
    analysis = analyse(question)
    if analysis.stop:
        return Decision("clarification", analysis.stop.code, message=analysis.stop.message, candidates=analysis.stop.candidates)
    if model is not None:
        prompt = question
        for _ in range(2):
            try:
                return Decision.from_json(model(prompt))
            except (DecisionError, json.JSONDecodeError, KeyError, TypeError) as e:
                prompt = f"{question}\n\n[이전 응답의 오류] {e}"
    if not analysis.operations:
        return Decision("ready", "words", ("document_explain",), retrieval_query=analysis.question)
    text = any(o in TEXT_OPERATIONS for o in analysis.operations)
    return Decision("ready", "words", analysis.operations[:MOST_REQUESTS], retrieval_query=analysis.question if text else None)


def guard_decision(decision: Decision) -> Clarification | None:
    """Why a decision isn't carried out: it asks back, mixes engines, or asks for several calculations at once."""
    if decision.status != "ready":
        return Clarification(decision.status, decision.message or "", decision.candidates)
    engines = {engine_of(o) for o in decision.operations}
    if len(engines) > 1:
        return Clarification("cross_engine", "표와 문서 질문을 나누어 물어봐 주세요", decision.operations)
    if len(decision.operations) > 1 or len(decision.requests) > 1:
        return Clarification("several_operations", "한 번에 한 가지만 물어봐 주세요", decision.operations)
    return None


def planned(question: str, table: TableRef, model: Callable[[str], str], check: Callable[[QueryPlan], list[Issue]]) -> QueryPlan:
    """A model's plan, brought into line and checked; asked once more with what stands against it, then a question back."""
    prompt, problem = question, "no plan"
    for _ in range(2):
        try:
            plan = aligned(QueryPlan.from_json(model(prompt)), question, table)
            issues = check(plan)
            if not issues:
                return plan
            problem = "; ".join(i.message for i in issues)
        except (PlanError, json.JSONDecodeError, KeyError, TypeError) as e:
            problem = str(e)
        prompt = f"{question}\n\n[이전 계획의 오류] {problem}"
    return QueryPlan(status="clarification", message=f"plan: {problem}")


OR_WORDS = r"또는|이거나|거나\s|혹은"
#: How far a literal may lie from the stored value it is taken for, as a share of the longer one's letters, and as such if the question writes that value out.
FAR, FAR_IF_ASKED = 0.34, 0.6


def aligned(plan: QueryPlan, question: str, table: TableRef, index: CellIndex | None = None) -> QueryPlan:
    """A plan whose filters agree with the question: types, stored values, stated comparisons, and/or, and no filter that only repeats a rank."""
    if plan.status != "ready":
        return plan
    typed_ = [by_type(f, table) for f in plan.filters]
    out = plan.with_(filters=tuple(by_evidence(f, question, table) for f in by_stored(typed_, question, table, index)))
    logic = joined_by(out.filters, question)
    joined = {f.column for f in out.filters}
    if logic:
        out = out.with_(filter_logic=logic)
    elif out.filter_logic == "any" and not re.search(OR_WORDS, question) and len(joined) == len(out.filters):
        out = out.with_(filter_logic="all")
    if out.rank_position is not None:
        rank = str(out.rank_position)
        out = out.with_(filters=tuple(f for f in out.filters if not (f.operator in ("eq", "gte", "lte") and str(f.value) == rank and f.column == (out.sort[0].column if out.sort else out.target))))
    return out


def joined_by(filters: tuple[FilterCondition, ...], question: str) -> str | None:
    """``any`` or ``all`` where the question writes all filters out: an "or" counts for the two that it stands between. None where it mixes them or doesn't say."""
    places = []
    for f in filters:
        written_ = f.source_text or str(f.value)
        at = question.find(written_)
        if at < 0 or isinstance(f.value, tuple):
            return None
        places.append((at, at + len(written_)))
    places.sort()
    gaps = {bool(re.search(OR_WORDS, question[a[1] : b[0]] + " ")) for a, b in zip(places, places[1:], strict=False)}
    return None if len(gaps) != 1 else "any" if gaps.pop() else "all" if not re.search(OR_WORDS, question) and len({f.column for f in filters}) == len(filters) else None


def by_stored(filters: list[FilterCondition], question: str, table: TableRef, index: CellIndex | None = None) -> list[FilterCondition]:
    """Filters on text whose literals no cell holds, with the one stored value each can only mean.

    That is the only one of the same plain form, else the longest one that the literal begins with (so particles and suffixes fall away), else the only nearest one by edit
    distance, nearer ones needed where the question doesn't write it out. Distances are taken in Spark over distinct cells, in one job for all filters, so only candidates come back.
    """
    asked = [(i, f) for i, f in enumerate(filters) if f.operator in ("eq", "ne", "contains") and isinstance(f.value, str) and normal(f.value) and f.column in table.frame.columns and table.meaning(f.column).data_type == "string"]
    if not asked:
        return filters
    parts = []
    for i, f in asked:
        if index is not None:
            cells = index.store.of_source(table.alias).where((F.col("kind") == BEGINS) & (F.col("column") == f.column)).select("value", "plain").distinct()
        else:
            cells = table.frame.select(F.trim(F.col(f"`{f.column}`").cast("string")).alias("value")).where("value <> ''").distinct().withColumn("plain", plain(F.col("value")))
        literal_ = F.lit(normal(f.value))
        begins = F.startswith(literal_, F.col("plain")) & (F.length("plain") >= 2)
        held = F.contains("value", F.lit(f.value)) if f.operator == "contains" else F.lower(F.trim("value")) == F.lower(F.lit(f.value.strip()))
        far = F.levenshtein(F.col("plain"), literal_) / F.greatest(F.length("plain"), F.length(literal_))
        said = F.contains(F.lit(normal(question)), F.col("plain")) & (F.length("plain") >= 2)
        rank = F.when(held, 0).when(F.col("plain") == literal_, 1).when(begins, 2).when((far <= FAR) | said & (far <= FAR_IF_ASKED), 3)
        far = F.when(rank == 2, -F.length("plain")).when(rank == 3, far - F.when(said, 1.0).otherwise(0.0)).otherwise(0.0)
        ranked = cells.select(F.lit(i).alias("i"), "value", rank.alias("rank"), far.cast("double").alias("far")).where("rank IS NOT NULL")
        parts.append(ranked.groupBy("i", "rank", "far").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n")).orderBy("rank", "far").limit(1))
    out = list(filters)
    for r in reduce(DataFrame.unionByName, parts).collect():
        f = filters[r["i"]]
        if r["rank"] > 0 and r["n"] == 1:
            out[r["i"]] = FilterCondition(f.column, f.operator, r["value"], f.case_sensitive, f.source_text if f.source_text and f.source_text in question else None)
    return out


def by_type(f: FilterCondition, table: TableRef) -> FilterCondition:
    """A filter whose value is of the column's type, where it can be read so; ``contains`` on other than text becomes equality."""
    kind = table.meaning(f.column).data_type if f.column in table.frame.columns else "string"
    number = lambda v: float(v.replace(",", "")) if isinstance(v, str) and re.fullmatch(r"\s*[+-]?[\d,]+(?:\.\d+)?\s*", v) else v
    operator, value = f.operator, f.value
    if kind in NUMERIC:
        value = tuple(number(v) for v in value) if isinstance(value, tuple) else number(value)
    elif kind == "string" and value is not None:
        text = lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
        value = tuple(text(v) for v in value) if isinstance(value, tuple) else text(value)
    if operator == "contains" and kind != "string":
        operator = "eq"
    return FilterCondition(f.column, operator, value, f.case_sensitive, f.source_text)


def by_evidence(f: FilterCondition, question: str, table: TableRef) -> FilterCondition:
    """A comparison as the question writes it, where it writes exactly one with that number; other filters stay."""
    if f.operator not in ("gt", "gte", "lt", "lte", "eq") or table.meaning(f.column).data_type not in NUMERIC:
        return f
    digits = re.sub(r"[^\d.]", "", str(f.value)).removesuffix(".0")
    same = [c for c in comparisons(question) if digits and digits.rstrip("0") == re.sub(r"[^\d.]", "", f"{c.value:.10g}").rstrip("0")]
    return FilterCondition(f.column, same[0].operator, f.value, f.case_sensitive, same[0].text) if len(same) == 1 else f


def lookup_contract(plan: QueryPlan, question: str, table: TableRef) -> list[Issue]:
    """A lookup of a field must return the fields that the question names, and rows of the one thing that it names."""
    if plan.status != "ready" or plan.operation != "list":
        return []
    filtered = {f.column for f in plan.filters}
    wanted = [c for c in requested_columns({c: table.meaning(c) for c in table.visible}, question) if c not in filtered]
    missing = [c for c in wanted if plan.select and c not in plan.select]
    out = [Issue("projection", f"columns of the question are left out: {', '.join(missing)}", tuple(missing))] if missing else []
    if wanted and not plan.filters and re.search(r"의\s", question):
        out.append(Issue("projection", "the question names something that no filter finds"))
    return out


def name_stretches(question: str) -> list[str]:
    """Stretches of a question that may be a name before a word for an amount or a field."""
    return list(dict.fromkeys(re.findall(r"([가-힣*]{2,5}?)(?:의|이|가|은|는|님|씨)?\s+(?=[가-힣]*(?:금액|얼마|학과|연락처|기수|총액|합계))", question)))


def stored_names(table: TableRef, fits: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(name, first_row)`` of each different name of a table's people."""
    name = person_name(F.col(f"`{table.people[0]}`"))
    names = table.frame.select(name.alias("name"), POSITION).where(F.length("name") >= 2)
    return (names.where(fits(F.col("name"))) if fits else names).groupBy("name").agg(F.min(POSITION).alias("first_row"))


def absent_people(tables: Tables, question: str, index: CellIndex | None = None) -> list[str]:
    """Names before a word for an amount or a field that no table holds, neither written out nor masked, in no cell: their amount must not be answered by all rows.

    A category or a department that some cell holds is no absent person.
    """
    asked = [n for n in name_stretches(question) if re.fullmatch(r"[가-힣]{2,4}", n) and n not in NO_VALUES and not re.search(r"[금액]$|학과|번호|일자|얼마|합계|평균|전체|모든", n)]
    known: set[str] = set()
    for table in tables.values():
        if not table.people or not asked:
            continue
        pattern = lambda n: F.concat(F.lit("^"), F.regexp_replace(n, r"\*", "[가-힣]"), F.lit("$"))
        fits = lambda n: n.isin(*asked) | (is_masked(n) & F.exists(F.array(*map(F.lit, asked)), lambda q: F.rlike(q, pattern(n))))
        for r in stored_names(table, fits).collect():
            known |= {q for q in asked if re.fullmatch(r["name"].replace("*", "[가-힣]"), q)}
    held = index.held(asked) if index is not None else scanned_cells(tables, asked) if asked and tables else set()
    known |= {word for _, _, word in held}
    return [n for n in asked if n not in known and not any(n in about.label or n in about.source for about in tables.values())]


def people_catalog(tables: Tables, most: int = MOST_NAMES) -> tuple[list[str], bool]:
    """Names to complete from: all of them if there are at most ``most``, else none, and whether they must be looked up."""
    parts = [stored_names(t, is_person).select("name") for t in tables.values() if t.people]
    if not parts:
        return [], False
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    names = [r["name"] for r in whole.distinct().orderBy("name").limit(most + 1).collect()]
    return (names, False) if len(names) <= most else ([], True)


def date_catalog(table: TableRef, column: str, at: Column) -> DataFrame:
    """``(year, month, n)`` of the dates of a column, to complete from."""
    return table.frame.select(F.year(at).alias("year"), F.month(at).alias("month")).where("year IS NOT NULL").groupBy("year", "month").agg(F.count("*").alias("n"))


@contextmanager
def cancellable(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Jobs that run inside can be stopped from another thread by what this gives."""
    group = uuid.uuid4().hex
    spark.addTag(group)
    try:
        yield lambda: spark.interruptTag(group)
    finally:
        spark.removeTag(group)


ENUMERATED = ("구분", "유형", "종류", "학과", "학년", "상태", "분야")


def schema_text(tables: Tables) -> str:
    """Tables as text for a model that plans: visible columns, meanings, one row with private cells hidden, and the values of short lists.

    One row of aggregates comes back from each table.
    """
    out = []
    for alias, table in sorted(tables.items(), key=lambda t: (t[1].source, t[0])):
        listed = [c for c in table.visible if any(w in c for w in ENUMERATED)]
        cells = [F.min_by(F.col(f"`{c}`").cast("string"), F.col(POSITION)).alias(f"c{i}") for i, c in enumerate(table.visible)]
        sets = [F.slice(F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))), 1, 21).alias(f"s{i}") if table.meaning(c).data_type == "string" else F.array().cast("array<string>").alias(f"s{i}") for i, c in enumerate(listed)]
        row = table.frame.agg(F.count("*").alias("n"), *cells, *sets).collect()[0]
        shown = ((c, table.meaning(c), row[f"c{i}"]) for i, c in enumerate(table.visible))
        sample = ", ".join(f"{c}={'[민감정보]' if m.sensitivity != 'normal' or m.pii_type else repr(v[:20])}" for c, m, v in shown if v not in (None, "", "None", "nan"))[:200]
        meanings = [f'"{c}"={m.concept}/{m.role}' + (f"/{m.qualifier}" if m.qualifier else "") for c in table.visible if (m := table.meaning(c)).role != "unknown" and m.confidence >= 0.75]
        lines = [f"파일: {table.source}", f"  표: {alias} ({row['n']}행) 레이블: {table.label}", "  컬럼: " + ", ".join(f'"{c}"' for c in table.visible), f"  예시: {sample}"]
        lines += [f"  의미: {', '.join(meanings)}"] if meanings else []
        lines += [f"  \"{c}\"의 값: {', '.join(row[f's{i}'][:15])}" for i, c in enumerate(listed) if 0 < len(row[f"s{i}"]) <= 20]
        out.append("\n".join(lines))
    return "\n\n".join(out)


def relevant_tables(tables: Tables, question: str, most: int = 4) -> Tables:
    """Tables whose cells hold words of the question, and those whose document does; all of them if none."""
    chosen = {*cell_conditions(tables, question), *tables_by_label(tables, question)[:most]}
    return {a: t for a, t in tables.items() if a in chosen} or dict(tables)
