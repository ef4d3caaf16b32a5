"""Plans compiled to lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import to_timestamp
from ledgerloom.functions.money import HINTS, money, money_hint
from ledgerloom.functions.names import person_name
from ledgerloom.plans.model import FilterCondition, QueryPlan
from ledgerloom.plans.table import NUMERIC, POSITION, TableRef

STORED_NUMBERS = ("double", "float", "bigint", "int", "smallint", "tinyint", "decimal")
NULL_WORDS = ("", "none", "nan", "nat", "null")


def typed(table: TableRef, column: str) -> Column:
    """A column as its logical type says; null where the cell isn't of that type."""
    meaning, c = table.meaning(column), F.col(f"`{column}`")
    stored = table.frame.schema[column].dataType.simpleString()
    if meaning.data_type == "money":
        hint = money_hint(column, meaning.unit)
        if not stored.startswith(STORED_NUMBERS):
            return money(c, hint)
        # numbers need no reading as text, which would lose those that are written with an exponent
        return c.cast("double") if HINTS.get(hint or "KRW", 1) == 1 else c.cast("double") * float(HINTS[hint])
    if meaning.data_type == "number":
        return c.cast("double") if stored != "string" else c.try_cast("double")
    if meaning.data_type in ("date", "year_month"):
        return c if stored.startswith(("timestamp", "date")) else to_timestamp(c)
    if meaning.data_type == "boolean":
        return c if stored == "boolean" else c.try_cast("boolean")
    return person_name(c) if meaning.is_person else F.trim(c.cast("string"))


def literal(table: TableRef, column: str, value) -> Column:
    """A filter's value as the column's type; bare numbers take the unit of the column."""
    meaning = table.meaning(column)
    if meaning.data_type == "money":
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return F.lit(float(value) * HINTS.get(money_hint(column, meaning.unit) or "KRW", 1))
        return money(F.lit(value))
    if meaning.data_type == "number":
        return F.lit(float(value))
    if meaning.data_type in ("date", "year_month"):
        plain = to_timestamp(F.lit(str(value)))
        return plain.cast("timestamp_ntz") if table.frame.schema[column].dataType.simpleString() == "timestamp_ntz" else plain
    if meaning.data_type == "boolean":
        return F.lit(bool(value))
    text = F.trim(F.lit(str(value)))
    return person_name(text) if meaning.is_person else text


def condition(table: TableRef, f: FilterCondition) -> Column:
    """One filter as a boolean that is never null."""
    c, meaning = typed(table, f.column), table.meaning(f.column)
    text = meaning.data_type in ("string", "empty")
    false = F.lit(False)
    if f.operator in ("is_null", "not_null"):
        empty = c.isNull() | (F.lower(F.trim(c.cast("string"))).isin(*NULL_WORDS) if text else false)
        return empty if f.operator == "is_null" else ~empty
    if f.operator == "in":
        return F.coalesce(reduce(lambda a, b: a | b, (c == literal(table, f.column, v) for v in f.value)), false)
    if f.operator == "between":
        low, high = (literal(table, f.column, v) for v in f.value)
        return F.coalesce((c >= low) & (c <= high), false)
    v = literal(table, f.column, f.value)
    if f.operator == "contains":
        return F.coalesce(F.contains(c, v) if f.case_sensitive else F.contains(F.lower(c), F.lower(v)), false)
    if f.operator in ("eq", "ne") and text and not f.case_sensitive and not meaning.is_person:
        c, v = F.lower(c), F.lower(v)
    if f.operator == "eq":
        return F.coalesce(c == v, false)
    if f.operator == "ne":  # text that is null fails, other nulls pass
        return F.coalesce(c != v, false) if text else ~c.eqNullSafe(v)
    compare = {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}
    return F.coalesce(compare[f.operator], false)


def predicate(table: TableRef, plan: QueryPlan) -> Column:
    parts = [condition(table, f) for f in plan.filters]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if plan.filter_logic == "all" else (lambda a, b: a | b), parts)


def keep_first(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The first row, by position, of each key; null keys equal each other."""
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys, strict=True)))
    first = keyed.groupBy(*names).agg(F.min(POSITION).alias("__first"))
    match = [keyed[n].eqNullSafe(first[n]) for n in names] + [keyed[POSITION] == first["__first"]]
    return keyed.join(first, reduce(lambda a, b: a & b, match), "left_semi").drop(*names)


def ordering(table: TableRef, plan: QueryPlan) -> list[Column]:
    """Sort keys with nulls last either way, then the position."""
    out = [typed(table, s.column).asc_nulls_last() if s.direction == "asc" else typed(table, s.column).desc_nulls_last() for s in plan.sort]
    return [*out, F.col(POSITION).asc()]


def at_dense_rank(df: DataFrame, value: Column, rank: int, descending: bool) -> DataFrame:
    """Rows that hold the value of a dense rank. Only ``rank`` distinct values meet in one place."""
    values = df.select(value.alias("__v")).where("__v IS NOT NULL").distinct()
    top = values.orderBy(F.desc("__v") if descending else F.asc("__v")).limit(rank)
    pick = top.agg((F.min if descending else F.max)("__v").alias("__v"), F.count("*").alias("__n")).where(F.col("__n") == rank).select("__v")
    return df.withColumn("__w", value).join(F.broadcast(pick), F.col("__w") == F.col("__v")).drop("__v", "__w")


def at_extreme(df: DataFrame, value: Column, descending: bool) -> DataFrame:
    """Rows tied at the extreme, found by one aggregate rather than a global window."""
    best = df.agg((F.max if descending else F.min)(value).alias("__best"))
    return df.withColumn("__w", value).join(F.broadcast(best), F.col("__w") == F.col("__best")).drop("__best", "__w")


def exact_sum(rows: DataFrame, c: Column) -> Column:
    """The sum of a column of ``rows``, of doubles as they are written, whatever the order of the rows; null if there are none.

    A sum of doubles depends on the order in which tasks meet them: worked out twice it may not equal itself, and sums that tie may differ. So digits down to
    eight places are added as decimals; what is left beyond (nothing, for money), and values of 1e20 and more, as doubles.
    """
    if rows.select(c).schema[0].dataType.simpleString() not in ("double", "float"):
        return F.sum(c)
    near = c.try_cast("decimal(28,8)")
    rest = c.cast("double") - F.coalesce(near.cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(near).cast("double"), F.lit(0.0)) + F.sum(rest)


#: Parts of one pass, and rows of a part that are counted value by value.
PARTS, FEW = 1 << 14, 10_000


def octave(v: Column) -> Column:
    """Sign and power of two of a number, as a whole number that ascends with it; NaN comes last."""
    size = F.abs(v)
    power = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))).cast("int") + 2000
    return F.when(F.isnan(v), 9000).when(size == float("inf"), F.signum(v).cast("int") * 8000).when(size == 0, 0).otherwise(F.signum(v).cast("int") * power)


def exact_median(rows: DataFrame, value: Column) -> DataFrame:
    """One row: the exact median as ``value``; null if there are no values.

    Digits are selected from the highest: a first pass counts values by sign and power of two, each further one counts those of the part that holds the
    middle by its own equal parts, until one value or few are left. A pass is one aggregate with map-side combine that gives back at most ``PARTS`` + 1 rows; its range is a
    plain filter, which reaches the scan. Four passes tell any two numbers apart; money takes two or three.
    """
    values = rows.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    counted = [F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    known: dict[tuple, list] = {}

    def parts_of(part) -> list:
        key = (part["low"], part["high"])
        if key not in known:
            inside = values.where((F.col("v") >= key[0]) & (F.col("v") <= key[1]))
            by = F.col("v") if part["n"] <= FEW else F.width_bucket("v", F.lit(key[0]), F.lit(key[1]), F.lit(PARTS))
            known[key] = inside.groupBy(by.alias("part")).agg(*counted).collect()
            known[key].sort(key=lambda p: (p["part"] != p["part"], p["part"]))
        return known[key]

    def at(rank: int, parts: list) -> float:
        for part in parts:
            if rank <= part["n"]:
                same = part["low"] == part["high"] or part["low"] != part["low"]
                return part["low"] if same else at(rank, parts_of(part))
            rank -= part["n"]
        raise ValueError("the rows changed between two passes")

    whole = sorted(values.groupBy(octave(F.col("v")).alias("part")).agg(*counted).collect(), key=lambda p: p["part"])
    n = sum(p["n"] for p in whole)
    middle = (at((n + 1) // 2, whole) + at(n // 2 + 1, whole)) / 2 if n else None
    return rows.sparkSession.createDataFrame([(middle,)], "value double")


@dataclass(frozen=True)
class Execution:
    """``result`` and ``evidence`` are lazy; ``matched`` holds the rows behind them."""

    plan: QueryPlan
    table: TableRef
    matched: DataFrame
    result: DataFrame
    evidence: DataFrame


def execute(plan: QueryPlan, table: TableRef) -> Execution:
    if plan.status != "ready":
        raise ValueError(plan.message)
    rows = table.frame.where(predicate(table, plan))
    if plan.distinct_by:
        rows = keep_first(rows, [typed(table, c) for c in plan.distinct_by])
    return Execution(plan, table, rows, RESULTS[plan.operation](plan, table, rows), evidence(plan, table))


def records(plan: QueryPlan, table: TableRef, rows: DataFrame) -> DataFrame:
    return rows.select(*(f"`{c}`" for c in (plan.select or table.visible)))


def run_list(plan: QueryPlan, table: TableRef, rows: DataFrame) -> DataFrame:
    if plan.rank_position is not None:
        first = plan.sort[0]
        rows = at_dense_rank(rows, typed(table, first.column), plan.rank_position, first.direction == "desc")
    rows = rows.orderBy(*ordering(table, plan))
    if plan.limit is not None:
        rows = rows.limit(plan.limit)
    return records(plan, table, rows)


def run_count(plan: QueryPlan, table: TableRef, rows: DataFrame) -> DataFrame:
    what = F.count(F.lit(1)) if plan.target is None else F.count(typed(table, plan.target))
    return rows.agg(what.alias("value"))


def run_value(plan: QueryPlan, table: TableRef, rows: DataFrame) -> DataFrame:
    t = typed(table, plan.target)
    if plan.result_mode == "person_totals":
        from ledgerloom.operators.identity import person_totals

        return person_totals(rows, table, plan.target)
    if plan.result_mode == "records":
        rows = rows.where(t.isNotNull())
        down = plan.operation == "max"
        if (plan.top_n or 1) == 1:
            rows = at_extreme(rows, t, down).orderBy(*ordering(table, plan))
        else:
            rows = rows.orderBy(t.desc() if down else t.asc(), *ordering(table, plan)).limit(plan.top_n)
        return records(plan, table, rows)
    if plan.operation == "mode":
        counts = rows.where(t.isNotNull()).groupBy(t.alias("value")).agg(F.count("*").alias("times"))
        return at_extreme(counts, F.col("times"), True).orderBy("value")
    if plan.operation == "median":
        return exact_median(rows, t)
    if plan.result_mode == "per_person":
        from ledgerloom.operators.identity import per_capita

        return per_capita(rows, typed(table, table.people[0]), t).select(F.col("per_capita").alias("value"), "people")
    how = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[plan.operation]
    return rows.agg(how(t).alias("value"))


def run_groups(plan: QueryPlan, table: TableRef, rows: DataFrame) -> DataFrame:
    """Sums by typed keys; without ``top_n`` all groups. Ties in total follow the first row of the group."""
    t = typed(table, plan.target)
    keys = [typed(table, c).alias(c) for c in plan.group_by]
    whole = rows.select(*keys, t.alias("__t"), POSITION).dropna(subset=[*plan.group_by, "__t"])
    sums = whole.groupBy(*plan.group_by).agg(exact_sum(whole, F.col("__t")).alias("total"), F.count("*").alias("n_rows"), F.min(POSITION).alias("__first"))
    down = plan.group_order != "asc"
    if plan.rank_position is not None:
        sums = at_dense_rank(sums, F.col("total"), plan.rank_position, down)
    elif plan.top_n == 1:
        sums = at_extreme(sums, F.col("total"), down)
    sums = sums.orderBy(F.desc("total") if down else F.asc("total"), "__first")
    if plan.top_n is not None and plan.top_n > 1:
        sums = sums.limit(plan.top_n)
    return sums.drop("__first")


RESULTS = {"list": run_list, "count": run_count, "group_sum": run_groups} | dict.fromkeys(("sum", "mean", "median", "mode", "min", "max"), run_value)


def evidence(plan: QueryPlan, table: TableRef) -> DataFrame:
    """One row from one pass: source, filtered, matched, valid and excluded rows, distinct people, distinct ranks."""
    keep = predicate(table, plan)
    aggregates = [F.count(F.lit(1)).alias("source_rows"), F.count_if(keep).alias("filtered_rows")]
    rows = table.frame
    if plan.distinct_by:
        before = rows.agg(*aggregates)
        rows, keep = keep_first(rows.where(keep), [typed(table, c) for c in plan.distinct_by]), F.lit(True)
        aggregates = []
    aggregates.append(F.count_if(keep).alias("matched_rows"))
    target = typed(table, plan.target) if plan.target else F.lit(1)
    aggregates += [F.count_if(keep & target.isNotNull()).alias("valid_rows"), F.count_if(keep & target.isNull()).alias("excluded_rows")]
    people = [F.countDistinct(F.when(keep, F.col(f"`{c}`"))) for c in table.people]
    aggregates.append((F.greatest(*people) if len(people) > 1 else people[0] if people else F.lit(None).cast("long")).alias("unique_people"))
    ranked = plan.sort[0].column if plan.operation == "list" and plan.sort else None
    aggregates.append((F.countDistinct(F.when(keep, typed(table, ranked))) if ranked else F.lit(None).cast("long")).alias("rank_values"))
    out = rows.agg(*aggregates)
    return before.crossJoin(out) if plan.distinct_by else out


def numeric(table: TableRef, column: str) -> bool:
    return table.meaning(column).data_type in NUMERIC
