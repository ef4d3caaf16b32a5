"""What columns mean, from their headers and a sample of their cells."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import asdict
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.table import POSITION, ColumnMeaning

SAMPLE, RATIO = 100, 0.8
# Shapes of cells.
SHAPES = {
    "number": r"(?i)^\s*[+-]?\s*(?:₩|KRW)?\s*\d[\d,]*(?:\.\d+)?\s*(?:원|천원|만원)?\s*$",
    "date": r"^\s*(?:19|20)\d{2}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2}\s*일?(?:[ T]\d{1,2}:\d{2}.*)?\s*$",
    "year_month": r"^\s*(?:19|20)\d{2}\s*[-./년]\s*\d{1,2}\s*월?\s*$",
    "phone": r"^\s*(?:\+?82[- ]?)?0?\d{1,2}[- ]\d{3,4}[- ]\d{4}\s*$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
}
PERSON = ("성명", "이름", "회원명", "회원성명", "학생명", "수혜자명", "기부자", "후원자", "출연자", "납부자", "입금자", "결제자", "신청자", "수혜자", "표시명", "성명원문", "성명검색키")
SYSTEM = ("source", "row_uid", "person_candidate_key", "entity_type", "성명_원문", "성명_검색키", "성명_마스킹패턴", "성명_마스킹여부", "표시명")
AMOUNT_ENDINGS = ("금액", "금", "액", "비용", "사업비")
UNIT_IN_HEADER = r"(?i)\s*[(\[{]\s*(?:KRW|원|천원|만원)\s*[)\]}]\s*$"
QUALIFIERS = (
    ("출연금", "donation"), ("기부금", "donation"), ("후원금", "sponsorship"), ("후원액", "sponsorship"), ("집행액", "executed"), ("집행금", "executed"), ("잔액", "remaining"), ("잔여액", "remaining"), ("불용액", "remaining"),
    ("본예산", "budget"), ("추경예산", "budget"), ("예산액", "budget"), ("예산금", "budget"), ("장학금", "scholarship"), ("장학액", "scholarship"), ("지원금", "support"), ("지원액", "support"), ("지급금", "payment"), ("지급액", "payment"), ("교부액", "allocated"), ("배정액", "allocated"),
)


def first_cells(batches: Iterator[pd.DataFrame], sample: int) -> Iterator[pd.DataFrame]:
    """``(at, i, v)``: the first non-blank cells of each column ``c<i>`` of a task's rows; ``sample`` a column are held."""
    held: dict[int, pd.DataFrame] = {}
    for batch in batches:
        for i in range(batch.shape[1] - 1):
            found = batch.iloc[:, [0, i + 1]].set_axis(["at", "v"], axis=1)
            kept = held.get(i)
            if kept is not None and len(kept) == sample:
                found = found[found["at"] < kept["at"].iloc[-1]]
            found = found[found["v"].notna() & (found["v"] != "")]
            if len(found):
                held[i] = pd.concat([*([] if kept is None else [kept]), found]).sort_values("at", kind="stable").head(sample)
    for i, kept in held.items():
        yield kept.assign(i=i)[["at", "i", "v"]]


def profile(df: DataFrame, columns: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """A row per column: cells sampled (the first non-blank ones) and the share of each shape among them.

    All columns come from one scan: each task keeps its first cells of every column, ``sample`` at most, and only those are ranked over all tasks.
    """
    columns = columns or [c for c in df.columns if not c.startswith("_")]
    cells = df.select(F.col(POSITION).alias("at"), *(F.trim(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(columns)))
    place = df.schema[POSITION].dataType.simpleString()
    each = cells.mapInPandas(partial(first_cells, sample=sample), f"at {place}, i int, v string")
    first = Window.partitionBy("i").orderBy("at")
    named = F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1).alias("column")
    out = each.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= sample).select(named, "v")
    shapes = [F.avg(F.when(F.col("v").rlike(p), 1.0).otherwise(0.0)).alias(n) for n, p in SHAPES.items()]
    whole = F.regexp_extract("v", r"^(\d+)(?:\.0+)?$", 1).try_cast("long")
    ranges = [F.avg(F.when(whole.between(a, b), 1.0).otherwise(0.0)).alias(n) for n, a, b in (("year", 1900, 2100), ("month", 1, 12), ("day", 1, 31))]
    in_row = (F.count(whole) > 1) & (F.count(whole) == F.count("*")) & (F.max(whole) - F.min(whole) + 1 == F.count("*")) & (F.countDistinct(whole) == F.count("*"))
    units = [F.max(F.contains("v", F.lit(u))).alias(n) for u, n in (("만원", "unit_10000"), ("천원", "unit_1000"))]
    return out.groupBy("column").agg(F.count("*").alias("cells"), *shapes, *ranges, in_row.alias("sequence"), *units)


def infer_type(stats: dict | None, stored: str = "string") -> str:
    if stored == "boolean":
        return "boolean"
    if stored.startswith(("timestamp", "date")):
        return "date"
    if stored != "string":
        return "number"
    if not stats or not stats["cells"]:
        return "empty"
    return "number" if stats["number"] >= RATIO else "date" if stats["date"] >= RATIO else "string"


def normal_header(header: str) -> str:
    """A header in one case, without white space, underscores and brackets."""
    return re.sub(r"[\s_()\[\]{}]+", "", header).casefold()


def meaning(header: str, stats: dict | None, stored: str = "string") -> ColumnMeaning:
    """The first rule that fits a column: contact, identifier, time, category, person, description, amount."""
    h = normal_header(header)
    amount = normal_header(re.sub(UNIT_IN_HEADER, "", unicodedata.normalize("NFKC", header)))  # a unit in brackets doesn't hide what a column is
    kind = infer_type(stats, stored)
    s = stats or {}
    share = lambda name: (s.get(name) or 0) >= RATIO
    has = lambda *words: any(w in h for w in words)
    if h.startswith("ocr"):
        return ColumnMeaning("ocr", "metadata", kind, confidence=0.9)
    if has("email", "이메일") or share("email"):
        return ColumnMeaning("contact", "email", "string", pii_type="email", sensitivity="sensitive", confidence=0.95)
    if has("전화", "연락처", "휴대폰", "핸드폰", "phone") or share("phone"):
        return ColumnMeaning("contact", "phone", "string", pii_type="phone", sensitivity="sensitive", confidence=0.95)
    if has("발행번호", "문서번호", "접수번호", "관리번호", "학번", "코드", "custkey", "orderkey"):
        return ColumnMeaning("identifier", "identifier", "string" if stored == "string" else kind, confidence=0.9)
    if h in ("연번", "번호", "no", "순번") or s.get("sequence") and has("번"):
        return ColumnMeaning("identifier", "sequence", kind, confidence=0.9)
    if has("년월", "연월") or share("year_month") and not share("date"):
        return ColumnMeaning("temporal", "year_month", "year_month", confidence=0.9)
    if h in ("연도", "년도", "년", "year") and (not stats or share("year")):
        return ColumnMeaning("temporal", "year", "number", confidence=0.9)
    if h in ("월", "month") and (not stats or share("month")):
        return ColumnMeaning("temporal", "month", "number", confidence=0.9)
    if h in ("일", "day") and (not stats or share("day")):
        return ColumnMeaning("temporal", "day", "number", confidence=0.9)
    if has("생년월일", "일자", "날짜", "일시", "date") or kind == "date":
        return ColumnMeaning("temporal", "date", "date", confidence=0.9, sensitivity="sensitive" if "생년" in h else "normal")
    if has("기수", "회차"):
        return ColumnMeaning("category", "cohort", kind, confidence=0.9)
    if has("학과", "전공", "계열", "학부", "부서"):
        return ColumnMeaning("category", "department", "string", confidence=0.9)
    if has("기관", "단체", "업체", "회사"):
        return ColumnMeaning("entity", "organization", "string", confidence=0.85)
    if h in PERSON or h.endswith("자명"):
        return ColumnMeaning("entity", "person", "string", pii_type="name", confidence=0.95)
    if has("구분", "유형", "종류", "방법"):
        return ColumnMeaning("category", "field", "string", confidence=0.8)
    if has("비고", "목적", "용도", "기준", "내용"):
        return ColumnMeaning("description", "note", "string", confidence=0.8)
    if amount.endswith((*AMOUNT_ENDINGS, "price", "acctbal")) and (not stats or kind == "number"):
        unit = "KRW_10000" if "만원" in h or s.get("unit_10000") else "KRW_1000" if "천원" in h or s.get("unit_1000") else "KRW"
        return ColumnMeaning("amount", "amount", "money", unit, 0.95 if qualifier(amount) else 0.8, qualifier=qualifier(amount))
    return ColumnMeaning(data_type=kind, confidence=0.4)


def qualifier(header: str) -> str | None:
    """What kind of amount a header speaks of; only headers that end as amounts do have one."""
    return next((q for w, q in QUALIFIERS if w in header), None) if header.endswith(AMOUNT_ENDINGS) else None


def is_source_column(column: str, meanings: dict[str, ColumnMeaning]) -> bool:
    """Whether a column came from the source and isn't internal, of the system or derived."""
    return not column.startswith("_") and column not in SYSTEM and not meanings.get(column, ColumnMeaning()).is_derived


def is_person_column(column: str, meanings: dict[str, ColumnMeaning], stats: dict | None = None) -> bool:
    """Whether the stored meaning says that a column names people, or else its header and cells do."""
    known = meanings.get(column)
    return known.is_person if known else meaning(column, stats).is_person


class Profiles:
    """Meanings kept by fingerprint: tables of the same columns and types take over what is known of them."""

    def __init__(self):
        self.held: dict[str, dict[str, ColumnMeaning]] = {}

    def keep(self, meanings: dict[str, ColumnMeaning]) -> str:
        key = fingerprint(meanings)
        self.held[key] = dict(meanings)
        return key

    def of(self, df: DataFrame) -> dict[str, ColumnMeaning]:
        """The meanings of a table: those kept for its fingerprint, else inferred ones, which are then kept."""
        fresh = infer(df)
        known = self.held.get(fingerprint(fresh))
        if known is None:
            self.keep(fresh)
        return known or fresh


def infer(df: DataFrame, cached: dict[str, ColumnMeaning] | None = None) -> dict[str, ColumnMeaning]:
    """Meanings of all columns from one profiling job; what a known profile says wins."""
    columns = [c for c in df.columns if not c.startswith("_")]
    stats = {r["column"]: r.asDict() for r in profile(df, columns).collect()}
    known = cached or {}
    return {c: known.get(c) or meaning(c, stats.get(c), df.schema[c].dataType.simpleString()) for c in columns}


def fingerprint(meanings: dict[str, ColumnMeaning]) -> str:
    text = "|".join(f"{re.sub(r'[^0-9a-z가-힣]', '', c.casefold())}:{m.data_type}" for c, m in meanings.items())
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def to_json(meanings: dict[str, ColumnMeaning]) -> dict:
    return {"version": "2.4", "columns": {c: asdict(m) for c, m in meanings.items()}}


def from_json(raw: dict) -> dict[str, ColumnMeaning]:
    return {c: ColumnMeaning(**m) for c, m in raw["columns"].items()}


def pick(meanings: dict[str, ColumnMeaning], concept: str | None = None, roles: tuple[str, ...] = (), data_type: str | None = None, confidence: float = 0.75) -> list[str]:
    return [c for c, m in meanings.items() if m.confidence >= confidence and (concept is None or m.concept == concept) and (not roles or m.role in roles) and (data_type is None or m.data_type == data_type)]


def amount_column(meanings: dict[str, ColumnMeaning], question: str) -> tuple[str | None, list[str]]:
    """The amount column that a question means, or None and the columns to choose from."""
    found = [c for c, m in meanings.items() if m.data_type == "money"]
    if len(found) <= 1:
        return (found[0] if found else None), found
    words = re.findall(r"[가-힣A-Za-z]{2,}", question)
    score = {c: sum(2 for w in words if w in c) + (3 if c in question else 0) for c in found}
    ranked = sorted(found, key=lambda c: -score[c])
    if score[ranked[0]] >= 2 and score[ranked[0]] - score[ranked[1]] >= 2:
        return ranked[0], found
    return None, found


def date_column(df: DataFrame, meanings: dict[str, ColumnMeaning], question: str, months: tuple[int, int] | None = None) -> str | None:
    """The date column that a question names, else the only one whose range covers ``months`` (year * 100 + month)."""
    from ledgerloom.functions.dates import to_timestamp

    found = [c for c, m in meanings.items() if m.data_type == "date"]
    named = [c for c in found if c in question]
    if len(named) == 1 or len(found) == 1:
        return (named or found)[0]
    if not found or months is None:
        return None
    key = {c: F.year(t) * 100 + F.month(t) for c in found for t in [to_timestamp(F.col(c))]}
    row = df.agg(*(x for c in found for x in (F.min(key[c]).alias(f"{c}_a"), F.max(key[c]).alias(f"{c}_b")))).collect()[0]
    covering = [c for c in found if row[f"{c}_a"] is not None and row[f"{c}_a"] <= months[0] and row[f"{c}_b"] >= months[1]]
    return covering[0] if len(covering) == 1 else None
