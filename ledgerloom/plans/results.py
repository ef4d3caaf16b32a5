"""Results for people: pages of rows, kept results, numbers, summaries of payments."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import blank_to_null, source_amount, source_month
from ledgerloom.plans.table import POSITION

PREVIEW, TTL, MAX_DETAILS, MAX_RESULTS, LISTED = 200, 15 * 60, 256, 32, 5


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by position: a top-n, not a global numbering."""
    return rows.orderBy(POSITION).limit(offset + limit).offset(offset)


def preview(rows: DataFrame, name: str, limit: int = PREVIEW) -> tuple[DataFrame, DataFrame]:
    """The first rows by source and name, and the number of all rows."""
    return rows.orderBy("source", name, POSITION).limit(limit), rows.agg(F.count("*").alias("n_rows"))


def number_text(value: float | int | None) -> str:
    """Thousands separators, at most two decimals, no trailing zeros."""
    if value is None:
        return ""
    text = f"{value:,.2f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def column_label(name: str) -> str:
    return name.removeprefix("col_").replace("_", " ").strip()


def payment_breakdown(rows: DataFrame, amount: Column) -> DataFrame:
    """Up to five payments in their order, one row each; of more, how often each amount was paid, in the order in which amounts first appear.

    The rule is decided within the plan: the number of payments is one broadcast row.
    """
    paid = rows.select(amount.alias("amount"), POSITION).where("amount IS NOT NULL")
    many = paid.agg((F.count("*") > LISTED).alias("__many"))
    first = F.when(F.col("__many"), F.lit(None).cast("long")).otherwise(F.col(POSITION))
    keyed = paid.join(F.broadcast(many)).withColumn("__one", first)
    return keyed.groupBy("amount", "__one").agg(F.count("*").alias("times"), F.min(POSITION).alias("first_row")).drop("__one").orderBy("first_row")


def source_summary(documents: DataFrame, by: str, size: str) -> DataFrame:
    """Rows and sizes of each source, with the number, month and amount that its name states."""
    grouped = documents.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(size).alias(size))
    return grouped.withColumns({"number": F.regexp_extract(by, r"(\d+)", 1).try_cast("int"), "month": source_month(F.col(by)), "stated_amount": source_amount(F.col(by))})


def entity_groups(rows: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Rows by identifier, name and cohort, in the order in which groups first appear; blank keys are null."""
    named = rows.withColumns({k: blank_to_null(F.col(k)) for k in keys})
    return named.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(amount).alias("total"), F.min(POSITION).alias("first_row")).orderBy("first_row")


class ResultStore:
    """Unevaluated results of a session by reference; old ones go after a while or when there are too many."""

    def __init__(self, most: int = MAX_DETAILS, ttl: float = TTL, clock: Callable[[], float] = time.monotonic):
        self.most, self.ttl, self.clock = most, ttl, clock
        self.held: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()

    def _prune(self) -> None:
        now = self.clock()
        for ref in [r for r, (at, _) in self.held.items() if now - at > self.ttl]:
            del self.held[ref]
        while len(self.held) > self.most:
            self.held.popitem(last=False)

    def put(self, rows: DataFrame) -> str:
        ref = uuid.uuid4().hex
        self.held[ref] = (self.clock(), rows)
        self._prune()
        return ref

    def get(self, ref: str) -> DataFrame | None:
        self._prune()
        found = self.held.get(ref)
        if found:
            self.held.move_to_end(ref)
        return found[1] if found else None
