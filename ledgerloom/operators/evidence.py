"""Answers that stand in retrieved chunks: responsible parties, periods, criteria, fields, clauses.

Chunks hold table rows as ``key: value / key: value`` or lines of text. All extractors are column expressions or
aggregations over ``(chunk_id, text)``; ties go to the smaller chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import CLAUSES, clause, numeric_criteria, overlap, table_fields, terms

# Words of headers and clauses.
PARTY = "담당|주관|책임|부서|기관"
TIME = "기간|일정|일시|시기|마감|기한"
SCALARS = {"people": "인원|선발|명", "amount": "금액|지원액|장학금", "period": "기간|일정|마감", "place": "장소|제출처", "contact": "문의|연락처|전화"}
EXCEPTIONS = "단,|다만|예외|제외"


def field_by_header(m: Column, pattern: str) -> Column:
    """The value of the first field whose name fits a pattern."""
    keys = F.filter(F.map_keys(m), lambda k: k.rlike(pattern))
    return F.try_element_at(m, F.try_element_at(keys, F.lit(1)))


def best_row(chunks: DataFrame, question: str, pattern: str) -> DataFrame:
    """The row that shares most terms with the question among those that have the field, and the field's value."""
    asked = chunks.sparkSession.range(1).select(terms(F.lit(question)).alias("t")).collect()[0]["t"]
    # Fields and terms of a text are worked out once: a filter on them would move below and work them out again. Rows whose rank is null don't count.
    fields = chunks.select("chunk_id", "text", table_fields(F.col("text")).alias("__fields"))
    found = fields.select("chunk_id", "text", field_by_header(F.col("__fields"), pattern).alias("value"))
    shared = overlap(F.array(*map(F.lit, asked)).cast("array<string>"), terms(F.col("text"), asked))
    scored = found.select("chunk_id", "value", F.when(F.col("value").isNotNull(), shared).alias("score"))
    rank = F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("s"), F.col("chunk_id")))
    best = scored.agg(F.min_by(F.struct("chunk_id", "value", "score"), rank).alias("b")).where("b IS NOT NULL")
    return best.select("b.*")


def responsible_party(chunks: DataFrame, question: str) -> DataFrame:
    return best_row(chunks, question, PARTY)


def period(chunks: DataFrame, question: str) -> DataFrame:
    return best_row(chunks, question, TIME)


def criteria_met(chunks: DataFrame, value: float) -> DataFrame:
    """Each numeric criterion of the chunks and whether a value meets it."""
    each = chunks.select("chunk_id", F.explode(numeric_criteria(F.col("text"))).alias("c")).select("chunk_id", "c.value", "c.operator")
    v = F.lit(float(value))
    met = F.when(F.col("operator") == "gte", v >= F.col("value")).when(F.col("operator") == "lte", v <= F.col("value")).when(F.col("operator") == "gt", v > F.col("value")).otherwise(v < F.col("value"))
    return each.withColumn("met", met)


def scalar_fields(chunks: DataFrame, kind: str) -> DataFrame:
    """``label: value`` lines whose label is of a kind, such as people or amount."""
    line = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"(?m)^\s*[-•○□]?\s*([^:\n]{1,30}:\s*[^\n]+)$"), F.lit(1)))
    each = chunks.select("chunk_id", line.alias("line"))
    label, value = F.trim(F.substring_index("line", ":", 1)), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    return each.where(label.rlike(SCALARS[kind])).select("chunk_id", label.alias("label"), value.alias("value"))


def total_difference(chunks: DataFrame, first: str, second: str, field: str) -> DataFrame:
    """The totals of two named rows and their difference."""
    m = table_fields(F.col("text"))
    number = F.regexp_replace(F.regexp_extract(field_by_header(m, field), r"([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")
    of = lambda name: F.min_by(F.when(F.contains("text", F.lit(name)), number), F.when(F.contains("text", F.lit(name)) & number.isNotNull(), F.col("chunk_id")))
    return chunks.agg(of(first).alias("first"), of(second).alias("second")).withColumn("difference", F.col("first") - F.col("second"))


def clauses(chunks: DataFrame, kind: str) -> DataFrame:
    """Exclusion, scope, mandatory, priority or preference clauses, a line for each chunk that has one."""
    out = clause(chunks, "text", CLAUSES[kind]).select("chunk_id", "clause")
    # To prefer some is not to exclude others.
    return out.where(~F.col("clause").rlike(CLAUSES["preference"])) if kind == "exclusion" else out


def priority_then_rest(chunks: DataFrame) -> DataFrame:
    """What comes first and what the remainder is for."""
    text = F.col("text")
    first = F.trim(F.regexp_extract(text, r"([^\n.]*우선[^\n.]*)", 1))
    rest = F.trim(F.regexp_extract(text, r"우선[^\n]*?[.\n]\s*([^\n.]*(?:잔여|나머지|남은)[^\n.]*)", 1))
    return chunks.select("chunk_id", first.alias("priority"), F.nullif(rest, F.lit("")).alias("remainder")).where("priority <> ''")


def exceptions(chunks: DataFrame) -> DataFrame:
    """Lines that take something back, to be added to an answer that leaves them out."""
    return clause(chunks, "text", EXCEPTIONS).select("chunk_id", "clause")


def missing_items(chunks: DataFrame, answer: str) -> DataFrame:
    """Numbered or bulleted items of the chunks that an answer doesn't mention."""
    items = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"(?m)^\s*(?:\d+[.)]|[-•○□①-⑮])\s*([^\n]{2,})$"), F.lit(1)))
    squeezed = lambda c: F.regexp_replace(F.lower(c), r"[\s\p{Punct}]", "")
    return chunks.select("chunk_id", items.alias("item")).select("chunk_id", F.trim("item").alias("item")).where(~F.contains(squeezed(F.lit(answer)), squeezed(F.col("item"))))


def numeric_evidence(chunks: DataFrame, concept: str) -> DataFrame:
    """Chunks that measure a concept; those with thresholds if there are any."""
    about = chunks.where(F.contains("text", F.lit(concept))).withColumn("__limits", F.size(numeric_criteria(F.col("text"))) > 0)
    some = about.agg(F.coalesce(F.bool_or("__limits"), F.lit(False)).alias("__some"))
    return about.join(F.broadcast(some), F.col("__limits") | ~F.col("__some")).drop("__limits", "__some")


def evidence_list(chunks: DataFrame) -> DataFrame:
    """Each (source, page, section) once, with its first chunk."""
    return chunks.groupBy("source", "page", "section_id").agg(F.min("chunk_id").alias("chunk_id"))


def table_alignment(header: list[str], line: str) -> dict[str, str] | None:
    """A text line read as a table row, if it has as many cells as the header."""
    import re

    cells = [c for c in re.split(r"\s{2,}|\t|\|", line.strip()) if c]
    return dict(zip(header, cells, strict=True)) if len(cells) == len(header) else None
