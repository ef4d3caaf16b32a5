"""Plans held against a table and the words of the question."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ledgerloom.functions.money import HINTS, money_hint
from ledgerloom.plans.model import FilterCondition, QueryPlan
from ledgerloom.plans.table import NUMERIC, ORDERED, TableRef

# Comparison words of questions.
COMPARISONS = {"이상": "gte", "초과": "gt", "이하": "lte", "미만": "lt", ">=": "gte", "<=": "lte", "≥": "gte", "≤": "lte", ">": "gt", "<": "lt"}
SCALES = {"억원": 100_000_000, "만원": 10_000, "천원": 1_000, "원": 1, "억": 100_000_000, "만": 10_000, "천": 1_000}
_NUMBER = r"(\d[\d,]*(?:\.\d+)?)\s*(억원|만원|천원|원|억|만|천|기|명|개|건|점|%)?"
_AFTER = re.compile(_NUMBER + r"\s*(이상|초과|이하|미만)")
_BEFORE = re.compile(r"(>=|<=|≥|≤|>|<)\s*" + _NUMBER)


@dataclass(frozen=True)
class Issue:
    code: str
    message: str
    candidates: tuple[str, ...] = ()


@dataclass(frozen=True)
class Comparison:
    operator: str
    value: float
    is_money: bool
    text: str


def comparisons(question: str) -> list[Comparison]:
    """Numeric comparisons that a question writes out."""
    found = []
    for m in _AFTER.finditer(question):
        found.append((m.start(), m[3], m[1], m[2], m[0]))
    for m in _BEFORE.finditer(question):
        found.append((m.start(), m[1], m[2], m[3], m[0]))
    return [Comparison(COMPARISONS[word], float(n.replace(",", "")) * SCALES.get(unit or "", 1), unit in SCALES, text.strip()) for _, word, n, unit, text in sorted(found)]


def validate(plan: QueryPlan, question: str, tables: dict[str, TableRef], selected: tuple[str, ...] = ()) -> list[Issue]:
    """What stands against running a plan; an empty list means it may run. Columns are never replaced."""
    if plan.status != "ready":
        return [Issue(plan.status, plan.message or "", plan.candidates)]
    sources = sorted({t.source for t in tables.values()})
    table = tables.get(plan.dataframe)
    if table is None:
        return [Issue("unknown_table", f"no table {plan.dataframe}", tuple(tables))]
    out: list[Issue] = []
    if len(sources) > 1 and plan.dataframe not in selected and table.source not in question:
        out.append(Issue("ambiguous_source", "several documents fit and none is named", tuple(sources)))
    roles = [("filter", f.column) for f in plan.filters] + [("sort", s.column) for s in plan.sort]
    roles += [("select", c) for c in plan.select] + [("distinct", c) for c in plan.distinct_by] + [("group", c) for c in plan.group_by]
    roles += [("target", plan.target)] if plan.target else []
    known = set(table.visible)
    for role, column in roles:
        if column not in known:
            out.append(Issue("hidden_column" if column in table.frame.columns else "unknown_column", f"{role} column {column} can't be used", tuple(table.visible)))
    if out:
        return out
    for f in plan.filters:
        kind = table.meaning(f.column).data_type
        if f.operator == "contains" and kind != "string":
            out.append(Issue("type", f"contains needs text, {f.column} is {kind}"))
        if f.operator in ("gt", "gte", "lt", "lte", "between") and kind not in ORDERED:
            out.append(Issue("type", f"{f.operator} needs an ordered column, {f.column} is {kind}"))
        for v in f.value if isinstance(f.value, tuple) else () if f.value is None else (f.value,):
            if kind == "number" and not isinstance(v, (int, float)):
                out.append(Issue("type", f"{f.column} is compared with {v!r}"))
    if plan.operation in ("sum", "mean", "median", "group_sum") and table.meaning(plan.target).data_type not in NUMERIC:
        out.append(Issue("type", f"{plan.operation} needs numbers, {plan.target} is {table.meaning(plan.target).data_type}"))
    if plan.operation in ("min", "max") and table.meaning(plan.target).data_type not in ORDERED:
        out.append(Issue("type", f"{plan.operation} needs an ordered column"))
    return out + grounding(plan, question, table)


def dates_stated(f: FilterCondition, question: str) -> bool:
    """Whether a date's year or month stands in the question; before an end that is left out, those of the month before."""
    numbers = {int(n) for n in re.findall(r"\d+", question)}
    for v in f.value if isinstance(f.value, tuple) else () if f.value is None else (f.value,):
        m = re.match(r"(\d{4})-(\d{1,2})", str(v))
        if not m:
            continue
        year, month = int(m[1]), int(m[2])
        before = (year - (month == 1), (month - 2) % 12 + 1) if f.operator == "lt" else ()
        if not numbers & {year, month, *before}:
            return False
    return True


def grounding(plan: QueryPlan, question: str, table: TableRef) -> list[Issue]:
    """Literals and limits must stand in the question, and comparisons of the question in the plan."""
    out: list[Issue] = []
    plain = re.sub(r"[\s,]", "", question).casefold()
    stated = comparisons(question)
    dated = [f for f in plan.filters if table.meaning(f.column).data_type in ("date", "year_month")]
    used = [f for f in plan.filters if f.operator in ("gt", "gte", "lt", "lte") and f not in dated]
    out += [Issue("ungrounded", f"{f.column} {f.value!r} isn't part of the question") for f in dated if not dates_stated(f, question)]
    for f in plan.filters:
        if f.source_text and f.source_text not in question:
            out.append(Issue("ungrounded", f"{f.source_text!r} isn't part of the question"))
        if f.operator in ("eq", "ne", "contains", "in") and table.meaning(f.column).data_type == "string":
            for v in f.value if isinstance(f.value, tuple) else (f.value,):
                if re.sub(r"[\s,]", "", str(v)).casefold() not in plain:
                    out.append(Issue("ungrounded", f"{v!r} isn't part of the question"))
    for f in used:
        text = isinstance(f.value, str)
        value = float(re.sub(r"[^\d.]", "", f.value) or 0) if text else float(f.value)
        meaning = table.meaning(f.column)
        # Text says its own unit; a bare number takes the column's, so an amount of the question is compared in won.
        times = next((s for u, s in SCALES.items() if u in f.value), 1) if text else HINTS.get(money_hint(f.column, meaning.unit) or "KRW", 1) if meaning.data_type == "money" else 1
        if not any(c.operator == f.operator and (abs(c.value - value * times) < 1e-6 if c.is_money or text else abs(c.value - value) < 1e-6) for c in stated):
            out.append(Issue("ungrounded", f"{f.operator} {f.value!r} isn't part of the question"))
    if len(stated) > len(used) + sum(f.operator == "between" for f in plan.filters) * 2:
        out.append(Issue("missing_filter", "a comparison of the question isn't in the plan", tuple(c.text for c in stated)))
    for name in ("limit", "top_n"):
        n = getattr(plan, name)
        if n is not None and n > 1 and not re.search(rf"(?<!\d){n}(?!\d)", question):
            out.append(Issue("ungrounded", f"{name} {n} isn't part of the question"))
    return out
