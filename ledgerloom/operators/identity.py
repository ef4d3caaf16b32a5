"""People behind rows: identity groups of equal names, totals by person, searches by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.operators.graph import linked_groups
from ledgerloom.plans.execute import at_extreme, exact_sum, typed
from ledgerloom.plans.table import POSITION, TableRef


def contact_key(column: str, c: Column) -> Column:
    value = F.regexp_replace(F.lower(c.cast("string")), r"[\s\-().]", "")
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(column + ":"), value))


def identity_groups(rows: DataFrame, name: Column, contacts: list[str], candidate: Column | None = None) -> DataFrame:
    """``rows`` with ``identity``, the first position of each person.

    Rows of a name that share a contact are one person. A row without contacts joins the person of its candidate key
    if that key has exactly one, else it goes with the other contactless rows of the key; without either it stands alone.
    """
    base = rows.withColumn("__name", name).withColumn("__cand", names.blank_to_null(candidate) if candidate is not None else F.lit(None).cast("string"))
    keys = F.array_compact(F.array(*(contact_key(c, F.col(c)) for c in contacts))) if contacts else F.array().cast("array<string>")
    base = base.withColumn("__keys", keys)
    members = base.select(F.col(POSITION).alias("row"), F.explode("__keys").alias("k"), "__name").select("row", F.concat_ws("|", "__name", "k").alias("key"))
    groups = linked_groups(members).withColumnRenamed("group", "__group").withColumnRenamed("row", POSITION)
    placed = base.join(groups, POSITION, "left")
    per_key = placed.where("__cand IS NOT NULL AND __group IS NOT NULL").groupBy("__name", "__cand").agg(F.countDistinct("__group").alias("__n"), F.min("__group").alias("__only"))
    loose = placed.where("__cand IS NOT NULL AND __group IS NULL").groupBy("__name", "__cand").agg(F.min(POSITION).alias("__loose"))
    out = placed
    for other in (per_key, loose):
        o = other.withColumnsRenamed({"__name": "__name2", "__cand": "__cand2"})
        out = out.join(o, out["__name"].eqNullSafe(o["__name2"]) & (out["__cand"] == o["__cand2"]), "left").drop("__name2", "__cand2")
    identity = F.coalesce("__group", F.when(F.col("__n") == 1, F.col("__only")), "__loose", POSITION)
    return out.withColumn("identity", identity).drop("__keys", "__group", "__n", "__only", "__loose", "__cand")


def person_totals(rows: DataFrame, table: TableRef, target: str) -> DataFrame:
    """Totals of each identity; the people of one name are numbered by their first row."""
    person = table.people[0]
    contacts = [c for c in table.frame.columns if table.meaning(c).pii_type in ("phone", "email")]
    candidate = F.col("_candidate_key") if "_candidate_key" in rows.columns else None
    grouped = identity_groups(rows.withColumn("__t", typed(table, target)), typed(table, person), contacts, candidate)
    sums = grouped.groupBy(F.col("__name").alias("person"), "identity").agg(F.sum("__t").alias("total"), F.count("__t").alias("payments"), F.min(POSITION).alias("first_row"))
    order = Window.partitionBy("person").orderBy("first_row")
    return sums.select("person", F.row_number().over(order).alias("number"), "total", "payments", "first_row")


def identity_key(columns: list[str]) -> Column:
    """The first of the columns that isn't blank."""
    return F.coalesce(*(names.blank_to_null(F.col(c)) for c in columns))


def count_people(rows: DataFrame, key: Column) -> DataFrame:
    return rows.agg(F.countDistinct(names.blank_to_null(key)).alias("people"))


def per_capita(rows: DataFrame, key: Column, amount: Column) -> DataFrame:
    """The mean of what each person's rows add up to, and how many people there are."""
    sums = rows.where(amount.isNotNull()).groupBy(names.blank_to_null(key).alias("k")).agg(F.sum(amount).alias("s")).where("k IS NOT NULL")
    return sums.agg(F.avg("s").alias("per_capita"), F.count("*").alias("people"))


def person_extremes(rows: DataFrame, key: Column, amount: Column, descending: bool = True, n: int = 1) -> DataFrame:
    """People with the largest or smallest sums: all ties for one, else the first ``n``."""
    sums = rows.where(amount.isNotNull()).groupBy(names.blank_to_null(key).alias("person")).agg(exact_sum(rows, amount).alias("total"), F.min(POSITION).alias("__first")).where("person IS NOT NULL")
    if n == 1:
        return at_extreme(sums, F.round("total", 6), descending).drop("__first")
    return sums.orderBy(F.desc("total") if descending else F.asc("total"), "__first").limit(n).drop("__first")


def extreme_rows(rows: DataFrame, amount: Column, subjects: list[str], descending: bool = True) -> DataFrame:
    """Every row at the extreme, with what it is about."""
    return at_extreme(rows.where(amount.isNotNull()), amount, descending).select(*subjects, amount.alias("amount"))


def name_search(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of the best class of match: 0 exact, 1 the same mask, 2 a mask that may hide the name, 3 contained."""
    lit = F.lit(query)
    key, mask = names.lookup_key(lit), names.mask_pattern(lit)
    # Each name is normalised once, in a projection of its own.
    stored = {c: f"__stored{i}" for i, c in enumerate(columns)}
    rows = rows.withColumns({s: names.lookup_key(F.col(c)) for c, s in stored.items()})
    classes = []
    for s in stored.values():
        masked = F.coalesce(F.col(s).rlike(names.MASKED), F.lit(False))
        hides = masked & (F.col(s) == mask)
        classes.append(F.when(F.col(s) == key, F.when(masked, 1).otherwise(0)).when(hides, 2).when(F.contains(F.col(s), key), 3))
    ranked = rows.withColumn("match_class", F.least(*classes) if len(classes) > 1 else classes[0]).where("match_class IS NOT NULL")
    best = ranked.agg(F.min("match_class").alias("__best"))
    return ranked.join(F.broadcast(best), F.col("match_class") == F.col("__best")).drop("__best", *stored.values())


def nearest_masked(rows: DataFrame, column: str, query: str, most: int = 180) -> DataFrame:
    """Rows whose masked name is closest to the query's."""
    near = rows.withColumn("distance", names.masked_distance(names.person_name(F.lit(query)), names.person_name(F.col(column)))).where(F.col("distance") <= most)
    best = near.agg(F.min("distance").alias("__best"))
    return near.join(F.broadcast(best), F.col("distance") == F.col("__best")).drop("__best")


def person_cards(rows: DataFrame, entity: Column, attributes: list[str], amount: Column) -> DataFrame:
    """One card per person: the first value of each attribute, and the number and sum of payments."""
    firsts = [F.min_by(F.col(c), F.when(names.blank_to_null(F.col(c)).isNotNull(), F.col(POSITION))).alias(c) for c in attributes]
    return rows.groupBy(entity.alias("entity")).agg(*firsts, F.count(amount).alias("payments"), F.sum(amount).alias("total"))


def payment_history(rows: DataFrame, entity: Column, columns: list[str]) -> DataFrame:
    """The different payments of each person, a row each with how often it stands there, in the order of their first rows; no person's payments are collected."""
    return rows.groupBy(entity.alias("entity"), *columns).agg(F.count("*").alias("times"), F.min(POSITION).alias("first_row")).where("entity IS NOT NULL")


def cohort_filter(rows: DataFrame, cohort_column: str, name_columns: list[str], cohort: str) -> DataFrame:
    """Rows of a cohort, by its column or by ``N회`` or ``N기`` in a name."""
    pattern = rf"(^|\D){cohort}\s*(회|기)"
    named = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in name_columns], F.lit(False))
    return rows.where(F.coalesce(names.cohort(F.col(cohort_column)) == cohort, F.lit(False)) | named)


def identifier_filter(rows: DataFrame, columns: list[str], wanted: list[str]) -> DataFrame:
    """Rows in which an identifier column holds one of the identifiers, however they are punctuated."""
    keys = [names.identifier(F.lit(w)) for w in wanted]
    return rows.where(reduce(lambda a, b: a | b, [F.coalesce(names.identifier(F.col(c)).isin(*keys), F.lit(False)) for c in columns]))


def organisation_search(rows: DataFrame, column: str, phrase: str) -> DataFrame:
    """Rows of the organisation that fits best: equal, at the end, or contained; none if several names fit."""
    key = names.lookup_key(F.lit(phrase))
    stored = names.lookup_key(F.col(column))
    rank = F.when(stored == key, 0).when(F.endswith(stored, key), 1).when((F.length(key) >= 3) & F.contains(stored, key), 2)
    ranked = rows.withColumn("match_rank", rank).withColumn("__stored", stored).where("match_rank IS NOT NULL")
    best = ranked.groupBy("match_rank").agg(F.countDistinct("__stored").alias("__names")).orderBy("match_rank").limit(1).where("__names = 1").select(F.col("match_rank").alias("__best"))
    return ranked.join(F.broadcast(best), F.col("match_rank") == F.col("__best")).drop("__best", "__stored")


def known_people(rows: DataFrame, kind_column: str) -> DataFrame:
    """Rows classified as people if any row is, else all rows."""
    is_person = F.coalesce(F.col(kind_column).rlike("^person"), F.lit(False))
    some = rows.agg(F.coalesce(F.bool_or(is_person), F.lit(False)).alias("__some"))
    return rows.join(F.broadcast(some), is_person | ~F.col("__some")).drop("__some")


def union_tables(frames: list[DataFrame], uid: str) -> DataFrame:
    """Tables of one source on top of each other; of rows with the same uid the first stays."""
    numbered = [f.withColumn("__table", F.lit(i)) for i, f in enumerate(frames)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    first = whole.groupBy(uid).agg(F.min(F.struct("__table", POSITION)).alias("__first"))
    return whole.join(first, uid).where(F.struct("__table", POSITION) == F.col("__first")).drop("__first", "__table")
