"""Comparisons of years, months, half-years and groups.

People are compared by normalised name. "Paid" means an amount above zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.names import blank_to_null, person_name
from ledgerloom.plans.execute import at_extreme, exact_sum
from ledgerloom.plans.table import POSITION


@dataclass(frozen=True)
class Roles:
    """Which expressions of a table play which part."""

    person: Column
    amount: Column
    year: Column | None = None
    month: Column | None = None
    group: Column | None = None


def _people(rows: DataFrame, r: Roles, paid: bool = True) -> DataFrame:
    chosen = rows.where(r.amount > 0) if paid else rows
    return chosen.withColumn("__key", person_name(r.person)).where("__key <> ''")


def year_people(rows: DataFrame, r: Roles, first: int, second: int) -> DataFrame:
    """Per name: what it paid in each of two years (null if nothing), and how it is first written."""
    people = _people(rows.where(r.year.isin(first, second)), r)
    of = lambda y: F.sum(F.when(r.year == y, r.amount))
    return people.groupBy("__key").agg(F.min_by(r.person, POSITION).alias("person"), of(first).alias("first_total"), of(second).alias("second_total")).drop("__key")


def years_both(rows: DataFrame, r: Roles, first: int, second: int) -> DataFrame:
    return year_people(rows, r, first, second).where("first_total IS NOT NULL AND second_total IS NOT NULL")


def years_later_only(rows: DataFrame, r: Roles, first: int, second: int) -> DataFrame:
    return year_people(rows, r, first, second).where("first_total IS NULL").select("person", "second_total")


def years_changed(rows: DataFrame, r: Roles, first: int, second: int, up: bool) -> DataFrame:
    both = years_both(rows, r, first, second)
    return both.where(F.col("second_total") > F.col("first_total") if up else F.col("second_total") < F.col("first_total"))


def years_people_count(rows: DataFrame, r: Roles, first: int, second: int) -> DataFrame:
    people = _people(rows, r)
    of = lambda y: F.countDistinct(F.when(r.year == y, F.col("__key")))
    return people.agg(of(first).alias("first_people"), of(second).alias("second_people")).withColumn("difference", F.col("second_people") - F.col("first_people"))


def nonpayers(rows: DataFrame, r: Roles, first: int, second: int) -> DataFrame:
    """People who paid in the first year and not in the second, by name."""
    return year_people(rows, r, first, second).where("first_total IS NOT NULL AND second_total IS NULL").select("person", "first_total").orderBy(F.lower("person"))


def _change(df: DataFrame) -> DataFrame:
    gap = F.col("second_total") - F.col("first_total")
    return df.withColumn("difference", gap).withColumn("rate", F.try_divide(gap * 100.0, F.col("first_total")))


def periods(rows: DataFrame, r: Roles, first: Column, second: Column) -> DataFrame:
    """Paid sums and distinct people of two periods, their difference and rate (null on a base of zero)."""
    people = _people(rows, r)
    parts = [(F.sum(F.when(p, r.amount)).alias(f"{n}_total"), F.countDistinct(F.when(p, F.col("__key"))).alias(f"{n}_people")) for n, p in (("first", first), ("second", second))]
    return _change(people.agg(*(x for pair in parts for x in pair)))


def half_years(rows: DataFrame, r: Roles) -> DataFrame:
    return periods(rows, r, r.month.between(1, 6), r.month.between(7, 12))


def group_rates(rows: DataFrame, r: Roles) -> DataFrame:
    """Per group: people, people who paid, paid sum and payment rate."""
    people = _people(rows, r, paid=False).withColumn("group", blank_to_null(r.group)).where("group IS NOT NULL")
    out = people.groupBy("group").agg(F.countDistinct("__key").alias("people"), F.countDistinct(F.when(r.amount > 0, F.col("__key"))).alias("paid_people"), F.sum(F.when(r.amount > 0, r.amount)).alias("paid_total"))
    return out.withColumn("rate", F.try_divide(F.col("paid_people") * 100.0, F.col("people"))).orderBy(F.desc("paid_total"), "group")


def year_amounts(rows: DataFrame, r: Roles, first: int, second: int) -> DataFrame:
    """Sums and row counts of two years over all rows, paid or not."""
    chosen = rows.where(r.year.isin(first, second) & r.amount.isNotNull())
    parts = [(F.sum(F.when(r.year == y, r.amount)).alias(f"{n}_total"), F.count_if(r.year == y).alias(f"{n}_rows")) for n, y in (("first", first), ("second", second))]
    return _change(chosen.agg(*(x for pair in parts for x in pair)))


def extreme_total(rows: DataFrame, r: Roles, by: Column, descending: bool, name: str = "key") -> DataFrame:
    """The years, months or groups with the largest or smallest sum, all ties."""
    sums = rows.where(r.amount.isNotNull() & by.isNotNull()).groupBy(by.alias(name)).agg(exact_sum(rows, r.amount).alias("total"), F.count("*").alias("n_rows"))
    return at_extreme(sums, F.round("total", 6), descending)


def extreme_count(rows: DataFrame, r: Roles, by: Column, descending: bool, paid: bool = False, name: str = "key") -> DataFrame:
    chosen = rows.where(r.amount > 0) if paid else rows
    return at_extreme(chosen.where(by.isNotNull()).groupBy(by.alias(name)).agg(F.count("*").alias("n_rows")), F.col("n_rows"), descending)


def most_frequent_person(rows: DataFrame, r: Roles, descending: bool = True, paid: bool = False) -> DataFrame:
    counts = _people(rows, r, paid).groupBy("__key").agg(F.min_by(r.person, POSITION).alias("person"), F.count("*").alias("n_rows")).drop("__key")
    return at_extreme(counts, F.col("n_rows"), descending)


def extreme_difference(rows: DataFrame, amount: Column) -> DataFrame:
    return rows.agg(F.max(amount).alias("largest"), F.min(amount).alias("smallest"), (F.max(amount) - F.min(amount)).alias("difference"))
