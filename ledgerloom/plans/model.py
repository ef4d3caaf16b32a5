"""The query plan: what a question asks of one table, independent of its columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any

OPERATIONS = ("list", "count", "sum", "mean", "median", "mode", "min", "max", "group_sum")
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in", "between", "is_null", "not_null")
MAX_FILTERS, MAX_LIMIT, MAX_TOP, MAX_KEYS, MAX_SELECT = 20, 500, 100, 10, 30
#: Fields that each operation may set beside filters; records of min and max are listed under "extreme".
ALLOWED = {
    "list": {"select", "sort", "distinct_by", "limit", "rank_position", "tie_policy", "result_mode"},
    "count": {"target", "distinct_by", "result_mode"},
    "sum": {"target", "distinct_by", "result_mode"},
    "mean": {"target", "distinct_by", "result_mode"},
    "median": {"target", "distinct_by", "result_mode"},
    "mode": {"target", "distinct_by", "result_mode"},
    "value": {"target", "distinct_by", "result_mode"},
    "extreme": {"target", "distinct_by", "result_mode", "select", "sort", "top_n"},
    "group_sum": {"target", "group_by", "group_order", "top_n", "rank_position", "tie_policy", "result_mode"},
}
MODES = {"list": {"records"}, "sum": {"value", "person_totals"}, "mean": {"value", "per_person"}, "min": {"value", "records"}, "max": {"value", "records"}, "group_sum": {"records"}}


class PlanError(ValueError):
    """A plan that breaks its contract."""


@dataclass(frozen=True)
class FilterCondition:
    column: str
    operator: str
    value: Any = None
    case_sensitive: bool = False
    source_text: str | None = None

    def __post_init__(self):
        if not self.column or self.operator not in OPERATORS:
            raise PlanError(f"unknown filter: {self.column!r} {self.operator!r}")
        many = isinstance(self.value, (list, tuple))
        if many:
            object.__setattr__(self, "value", tuple(self.value))
        if self.operator in ("is_null", "not_null"):
            wrong = self.value is not None
        elif self.operator == "between":
            wrong = not many or len(self.value) != 2
        elif self.operator == "in":
            wrong = not many or not self.value
        else:
            wrong = self.value is None or many or self.operator == "contains" and not isinstance(self.value, str)
        if wrong:
            raise PlanError(f"{self.operator} does not take {self.value!r}")


@dataclass(frozen=True)
class SortCondition:
    column: str
    direction: str = "asc"

    def __post_init__(self):
        if not self.column or self.direction not in ("asc", "desc"):
            raise PlanError(f"unknown sort: {self.column!r} {self.direction!r}")


@dataclass(frozen=True)
class QueryPlan:
    status: str = "ready"
    dataframe: str | None = None
    operation: str | None = None
    filters: tuple[FilterCondition, ...] = ()
    filter_logic: str = "all"
    select: tuple[str, ...] = ()
    target: str | None = None
    result_mode: str | None = None
    sort: tuple[SortCondition, ...] = ()
    distinct_by: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    group_order: str | None = None
    limit: int | None = None
    top_n: int | None = None
    rank_position: int | None = None
    tie_policy: str | None = None
    message: str | None = None
    candidates: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for name in ("filters", "select", "sort", "distinct_by", "group_by", "candidates"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        self._check()

    def _set(self) -> set[str]:
        return {f.name for f in fields(self) if getattr(self, f.name) not in (None, ()) and f.name not in ("status", "filter_logic")}

    def _check(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise PlanError(what)

        given = self._set()
        need(self.status in ("ready", "clarification", "not_applicable"), f"unknown status {self.status!r}")
        if self.status != "ready":
            need(bool(self.message), f"{self.status} needs a message")
            need(given <= {"message", "candidates"}, f"{self.status} must not ask for anything")
            return
        need(bool(self.dataframe), "a ready plan needs a table")
        need(self.operation in OPERATIONS, f"unknown operation {self.operation!r}")
        need(self.filter_logic in ("all", "any"), f"unknown filter logic {self.filter_logic!r}")
        need(len(self.filters) <= MAX_FILTERS and len(self.select) <= MAX_SELECT, "too many filters or columns")
        need(all(len(x) <= MAX_KEYS for x in (self.sort, self.distinct_by, self.group_by)), "too many keys")
        for name, most in (("limit", MAX_LIMIT), ("top_n", MAX_TOP), ("rank_position", MAX_TOP)):
            value = getattr(self, name)
            need(value is None or 1 <= value <= most, f"{name} must lie between 1 and {most}")
        need(self.group_order in (None, "asc", "desc") and self.tie_policy in (None, "dense"), "unknown order or tie policy")
        need(self.result_mode is None or self.result_mode in MODES.get(self.operation, {"value"}), f"{self.operation} can't return {self.result_mode}")
        kind = self.operation
        if kind in ("min", "max"):
            kind = "extreme" if self.result_mode == "records" else "value"
        extra = given - ALLOWED[kind] - {"dataframe", "operation", "filters", "message", "candidates"}
        need(not extra, f"{self.operation} must not set {', '.join(sorted(extra))}")
        need(self.operation in ("list", "count") or bool(self.target), f"{self.operation} needs a target")
        need(self.operation != "group_sum" or bool(self.group_by), "group_sum needs group_by")
        need(self.tie_policy is None or self.rank_position is not None, "tie_policy needs rank_position")
        if self.rank_position is not None:
            need(self.limit is None and self.top_n is None, "rank_position stands alone")
            need(self.operation == "group_sum" or bool(self.sort), "rank_position needs a sort")

    @property
    def records(self) -> bool:
        return self.operation in ("list", "group_sum") or self.result_mode in ("records", "person_totals")

    @staticmethod
    def from_json(text: str | dict) -> QueryPlan:
        """A plan from JSON; unknown fields are refused."""
        raw = dict(json.loads(text) if isinstance(text, str) else text)
        known = {f.name for f in fields(QueryPlan)}
        if extra := set(raw) - known:
            raise PlanError(f"unknown fields: {', '.join(sorted(extra))}")
        try:
            raw["filters"] = [FilterCondition(**f) for f in raw.get("filters") or ()]
            raw["sort"] = [SortCondition(**s) for s in raw.get("sort") or ()]
        except TypeError as e:
            raise PlanError(str(e)) from None
        return QueryPlan(**{k: v for k, v in raw.items() if v is not None})

    def with_(self, **changes) -> QueryPlan:
        return replace(self, **changes)
