"""Questions over several tables: which tables and rows they mean, and searches whose results are put together.

``tables`` is a mapping of alias to ``TableRef``, as a catalog gives it. What a question means is decided on the driver; whether cells hold
its words is one job over all tables. Where tables of several documents fit, a ``Notice`` asks back rather than mixing them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.functions.dates import component, month_range, to_timestamp
from ledgerloom.operators.cellindex import CellIndex
from ledgerloom.operators.nameblocks import NameIndex
from ledgerloom.plans.execute import typed
from ledgerloom.plans.table import POSITION, TableRef
from ledgerloom.sources.store import written

# Words that are no values of cells, endings, words that name no document, and headers.
NO_VALUES = (
    "장학금", "장학", "전기과", "건축과", "기계과", "화학과", "컴퓨터", "학과", "학년", "학생", "신입생", "재학생", "대상자", "수혜자", "성적", "우수자", "금액", "명단", "목록", "정보", "대학교",
    "이상", "이하", "미만", "해당", "지급", "기준", "선발", "알려줘", "알려주", "주세요", "해줘", "계열", "바이오", "화학", "동문장학", "동문회", "실습품", "확인서", "기능대회", "지원금",
    "공무원", "검도부", "관악부", "운동부", "축구부", "동기회", "총동문회", "대공동문회", "재단", "협회", "장학회", "주식회사", "중공업", "회사", "학년말", "성적우수", "총인원", "총금액", "얼마야", "얼마",
    "수령자", "수령확인", "출전선수", "학교운동", "스마트공간", "출연자", "기부자", "후원자", "발행번호", "발급번호", "접수번호",
)
PARTICLES = "의이가을를은는에도로과와며서"
NO_SOURCES = ("학생", "이름", "알려줘", "알려주", "주세요", "해줘", "누구", "누구야", "몇명", "인원", "총인원", "총금액", "얼마야", "얼마")
NAME_COLUMNS = ("성명", "이름", "학생명", "수혜자명", "학생이름", "수혜자", "명단", "학생", "이_름", "성_명")
DISPLAY_COLUMNS = ("기관명", "표시명", "이름", "성명_원문")
IDENTITY_COLUMNS = ("person_candidate_key", "성명_검색키", "표시명", "이름", "성명", "성명_원문")
LIST_COLUMNS = ("source", "기수", "학과", "전공", "학년", "표시명", "이름", "성명")
COHORT_COLUMNS, COHORT_NAMES = ("기수", "회차", "기수_원문", "cohort_from_name"), ("기관명", "표시명", "이름")
IDENTIFIER_HEADERS = ("번호", "식별", "관리번호", "발행번호", "발급번호", "접수번호", "등록번호", "문서번호")
INTERNAL_COLUMNS = ("성명_원문", "성명_검색키", "성명_마스킹패턴", "성명_마스킹여부", "row_uid", "person_candidate_key")
IDENTIFIER = re.compile(r"(?<!\d)(?:20\d{2}[-\s]?\d{3,}|[A-Za-z]{1,10}[-\s]?\d{2,})(?!\d)", re.I)
COHORT = re.compile(r"(?<!\d)(\d{1,3})\s*(?:회|기)(?!\d)")
PEOPLE = re.compile(r"사람|개인|학생|수혜자|기부자|후원자|출연자|납부자")
REQUESTS = r"알려\s*줘|알려\s*주세요|보여\s*줘|확인해\s*줘|해\s*줘|주세요|얼마(?:야|인가요|입니까)?"
AMOUNTS = "출연금액|출연금|지급액|장학금액|장학금|지원금액|지원금|수혜금액|수혜금|후원금액|후원금|기부금액|기부금|총금액|총액|합계|금액"
ENDING = re.compile(rf"(?:{REQUESTS}|{AMOUNTS})(?:은|는|이|가|을|를|도|만)?\s*$")
#: Words of a question that are looked up in cells, and names in a notice.
MOST_WORDS, MOST_NAMES = 10, 5
SOURCE = "source"


@dataclass(frozen=True)
class Notice:
    """Why nothing is answered: ``clarification`` asks for a choice, ``empty`` says that nothing fits."""

    kind: str
    message: str
    sources: tuple[str, ...] = ()


@dataclass(frozen=True)
class Found:
    """Rows with their ``source``, or a notice; ``evidence`` has a row for each table where there is one."""

    rows: DataFrame | None = None
    sources: tuple[str, ...] = ()
    notice: Notice | None = None
    evidence: DataFrame | None = field(default=None, compare=False)


Tables = dict[str, TableRef]


def bare(word: str) -> str:
    """A word without its particle."""
    return word[:-1] if len(word) >= 3 and word[-1] in PARTICLES else word


def value_words(question: str) -> list[str]:
    """Words that may be values of cells, each as written and without its particle, years and grades last."""
    found = [c for w in re.findall(r"[가-힣]{2,10}", question) for c in (w, bare(w))]
    kept = [c for c in found if len(c) >= 2 and (c not in NO_VALUES or c.endswith("과") and len(c) >= 3)]
    return list(dict.fromkeys([*kept, *re.findall(r"20\d{2}|[1-4]학년", question)]))


def source_words(question: str) -> set[str]:
    """Words that may name a document: as written, without one particle, without all."""
    out = set()
    for w in re.findall(r"[가-힣]{2,}|20\d{2}|\d+월|\d+분기", question):
        root = w
        while len(root) >= 3 and root[-1] in PARTICLES:
            root = root[:-1]
        out |= {c for c in (w, bare(w), root) if len(c) >= 2 and c not in NO_SOURCES}
    return out


def searched(table: TableRef) -> list[str]:
    """Columns whose cells are searched for words."""
    return [c for c in table.frame.columns if not c.startswith("_") and c not in INTERNAL_COLUMNS]


def text(column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def scanned_cells(tables: Tables, words: list[str]) -> set[tuple[str, str, str]]:
    """``(alias, column, word)`` for all columns whose cells hold a word. One job reads all tables."""
    rows = []
    for alias, table in tables.items():
        held = [F.coalesce(F.bool_or(F.contains(text(c), F.lit(w))), F.lit(False)) for w in words for c in searched(table)]
        rows.append(table.frame.agg(F.array(*held).alias("held") if held else F.array().cast("array<boolean>").alias("held")).select(F.lit(alias).alias("alias"), "held"))
    flags = {r["alias"]: r["held"] for r in reduce(DataFrame.unionByName, rows).collect()}
    return {(a, c, w) for a, t in tables.items() for (w, c), held in zip(((w, c) for w in words for c in searched(t)), flags[a], strict=True) if held}


def cell_conditions(tables: Tables, question: str, index: CellIndex | None = None) -> dict[str, list[tuple[str, str]]]:
    """For each table ``(column, word)``: the first column not yet used whose cells hold the word.

    With the tables' ``index`` no table is read. The first ``MOST_WORDS`` words of a question count; later ones are no conditions.
    """
    words = value_words(question)[:MOST_WORDS]
    if not words or not tables:
        return {}
    found = index.held(words) if index is not None else scanned_cells(tables, words)
    out: dict[str, list[tuple[str, str]]] = {}
    for alias, table in tables.items():
        columns, used = searched(table), set()
        for word in words:
            pick = next((c for c in columns if c not in used and (alias, c, word) in found), None)
            if pick is not None:
                used.add(pick)
                out.setdefault(alias, []).append((pick, word))
    return out


def fulfil(rows: DataFrame, conditions: list[tuple[str, str]]) -> DataFrame:
    """Rows whose cells hold all words."""
    return rows.where(reduce(lambda a, b: a & b, (F.coalesce(F.contains(text(c), F.lit(w)), F.lit(False)) for c, w in conditions), F.lit(True)))


def of_grade(rows: DataFrame, question: str) -> DataFrame:
    """Rows of the grade that a question names, by the first column about grades."""
    m = re.search(r"([1-4])학년", question)
    column = next((c for c in rows.columns if "학년" in c), None)
    return rows.where(F.coalesce(F.contains(text(column), F.lit(m[1])), F.lit(False))) if m and column else rows


def about(table: TableRef) -> str:
    return f"{table.source} {table.label}"


def tables_by_label(tables: Tables, question: str) -> list[str]:
    """Tables whose document or label holds words of the question, those with most words first."""
    words = source_words(question)
    score = {alias: sum(w in about(t) for w in words) for alias, t in tables.items()}
    return sorted((a for a, n in score.items() if n), key=lambda a: -score[a])


def tables_named(tables: Tables, question: str) -> list[str]:
    """The same, or tables whose file name, without its ending, or label the question writes out."""
    plain = lambda s: re.sub(r"[^0-9A-Za-z가-힣]", "", s).lower()
    q = plain(question)
    keys = {a: {plain(s) for s in (t.source, re.sub(r"\.[^.]+$", "", t.source), t.label) if s} for a, t in tables.items()}
    return tables_by_label(tables, question) or [a for a, found in keys.items() if any(len(k) >= 3 and k in q for k in found)]


def sourced(table: TableRef, rows: DataFrame | None = None) -> DataFrame:
    """A table's rows with their source."""
    rows = table.frame if rows is None else rows
    return rows if SOURCE in rows.columns else rows.withColumn(SOURCE, F.lit(table.source))


def together(parts: list[DataFrame]) -> DataFrame:
    """Rows of several tables; of rows with one uid the first, by table and position, stays. Rows without a uid all stay."""
    numbered = [p.withColumn("__table", F.lit(i)) for i, p in enumerate(parts)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    if "row_uid" not in whole.columns or len(parts) == 1:
        return whole.drop("__table")
    place = F.struct("__table", POSITION)
    first = whole.where("row_uid IS NOT NULL").groupBy(F.col("row_uid").alias("__uid")).agg(F.min(place).alias("__first"))
    later = whole.join(first, F.col("row_uid") == F.col("__uid"), "left").where(F.col("__first").isNull() | (place == F.col("__first")))
    return later.drop("__table", "__uid", "__first")


def distinct_sources(tables: Tables, aliases) -> tuple[str, ...]:
    return tuple(dict.fromkeys(tables[a].source for a in aliases))


def choose(message: str, sources: tuple[str, ...]) -> Found:
    return Found(sources=sources, notice=Notice("clarification", f"{message}: {', '.join(sources[:MOST_NAMES])}", sources))


def union_of(tables: Tables, aliases) -> Found:
    aliases = list(aliases)
    return Found(together([sourced(tables[a]) for a in aliases]), distinct_sources(tables, aliases))


def all_records(tables: Tables) -> Found:
    """All rows of the one document in scope; several documents are never mixed."""
    sources = distinct_sources(tables, tables)
    if not sources:
        return Found(notice=Notice("empty", "조회 가능한 표 데이터가 없습니다"))
    return choose("전체 목록을 조회할 문서를 하나 선택해주세요", sources) if len(sources) > 1 else union_of(tables, tables)


def year_named(table: TableRef) -> int:
    return max((int(y) for y in re.findall(r"20\d{2}", about(table))), default=0)


def aggregation_scope(tables: Tables, question: str, index: CellIndex | None = None) -> Found:
    """The rows that a calculation is about: those whose cells hold the question's words, else those of the document it names, else of the only one."""
    conditions = cell_conditions(tables, question, index)
    if conditions:
        sources = distinct_sources(tables, conditions)
        if len(sources) > 1:
            return choose("조건과 일치하는 기록이 여러 문서에 있습니다. 조회할 문서를 선택해주세요", sources)
        words = set(re.findall(r"[0-9A-Za-z가-힣]{2,}", question))
        best = max(conditions, key=lambda a: (len(conditions[a]), sum(w in about(tables[a]) for w in words), year_named(tables[a])))
        return Found(fulfil(sourced(tables[best]), conditions[best]), (tables[best].source,))
    named = tables_named(tables, question)
    if named:
        sources = distinct_sources(tables, named)
        return union_of(tables, named) if len(sources) == 1 else choose("조회할 문서를 하나로 특정해주세요. 일치하는 문서", sources)
    sources = distinct_sources(tables, tables)
    return union_of(tables, tables) if len(sources) == 1 else choose("조회할 문서를 지정해주세요. 현재 선택 가능한 문서", sources)


def direct_lookup(tables: Tables, question: str, index: CellIndex | None = None) -> Found:
    """Rows that a question asks for by words of cells or of a document's name, and by grade."""
    conditions = cell_conditions(tables, question, index)
    year = re.search(r"20\d{2}", question)
    words = set(re.findall(r"[가-힣]{2,}", question))

    def best(aliases: list[str]) -> str:
        of_year = [a for a in aliases if year and year[0] in about(tables[a])]
        return max(of_year or aliases, key=lambda a: (sum(w in about(tables[a]) for w in words), 0 if of_year else year_named(tables[a]), len(conditions.get(a, []))))

    if conditions:
        sources = distinct_sources(tables, conditions)
        if len(sources) > 1:
            return choose("조건과 일치하는 기록이 여러 문서에 있습니다. 조회할 문서를 선택해주세요", sources)
        pick = best(list(conditions))
        return Found(of_grade(fulfil(sourced(tables[pick]), conditions[pick]), question), (tables[pick].source,))
    labelled = tables_by_label(tables, question)
    if not labelled:
        return Found(notice=Notice("empty", "조건에 맞는 데이터가 없습니다"))
    pick = best(labelled) if year else labelled[0]
    return Found(of_grade(sourced(tables[pick]), question), (tables[pick].source,))


def of_last_year(rows: DataFrame, question: str) -> DataFrame:
    """Rows of sources that name the last year of the question, if there are any; else all rows."""
    years = re.findall(r"20\d{2}", question)
    if not years or SOURCE not in rows.columns:
        return rows
    fits = F.coalesce(F.contains(F.col(SOURCE), F.lit(years[-1])), F.lit(False))
    some = rows.agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("__some"))
    return rows.join(F.broadcast(some), fits | ~F.col("__some")).drop("__some")


def cohort_of(question: str) -> str | None:
    m = COHORT.search(question)
    return m[1] if m else None


def of_cohort(rows: DataFrame, question: str) -> DataFrame:
    """Rows of the cohort that a question names; other cohorts never stand in for it."""
    wanted = cohort_of(question)
    if wanted is None:
        return rows
    parts = [names.cohort(F.col(c)) == str(int(wanted)) for c in COHORT_COLUMNS if c in rows.columns]
    parts += [F.regexp_replace(text(c), r"\s+", "").rlike(rf"(?<!\d){wanted}(?:회|기)") for c in COHORT_NAMES if c in rows.columns]
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(False)))


def identifier_columns(columns: list[str]) -> list[str]:
    plain = {c: re.sub(r"\s+", "", c).lower() for c in columns}
    return [c for c, n in plain.items() if not c.startswith("_") and n not in ("rowuid", "personcandidatekey") and (n == "id" or any(h in n for h in IDENTIFIER_HEADERS))]


def plain_identifier(value: str) -> str:
    return re.sub(r"[^0-9A-Z가-힣]", "", value.upper())


def identifier_targets(tables: Tables, question: str) -> list[str]:
    """Identifiers that a question writes out: by their shape, then stored ones of four letters or more, in order of table, column and row.

    Stored ones are filtered by the question in Spark, so no more come back than the question can hold.
    """
    q = plain_identifier(question)
    found = [plain_identifier(m[0]) for m in IDENTIFIER.finditer(question)]
    parts = []
    for i, table in enumerate(tables.values()):
        for j, c in enumerate(identifier_columns(table.frame.columns)):
            key = names.identifier(F.col(f"`{c}`"))
            parts.append(table.frame.select(F.lit(i).alias("t"), F.lit(j).alias("c"), F.col(POSITION).alias("p"), key.alias("key")))
    if parts:
        stored = reduce(DataFrame.unionByName, parts).where((F.length("key") >= 4) & F.contains(F.lit(q), F.col("key")))
        firsts = stored.groupBy("key").agg(F.min(F.struct("t", "c", "p")).alias("at")).collect()
        found += [r["key"] for r in sorted(firsts, key=lambda r: tuple(r["at"]))]
    return list(dict.fromkeys(k for k in found if k))


def of_identifiers(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Rows that hold one of the identifiers; all rows where none is asked for."""
    if not targets:
        return rows
    parts = [F.coalesce(names.identifier(F.col(f"`{c}`")).isin(*targets), F.lit(False)) for c in identifier_columns(rows.columns)]
    return rows.where(reduce(lambda a, b: a | b, parts, F.lit(False)))


def found_rows(parts: list[DataFrame], tables: Tables, question: str, match: str) -> Found:
    if not parts:
        return Found(notice=Notice("empty", "조건에 맞는 데이터가 없습니다"))
    rows = of_last_year(together([p.withColumn("_match", F.lit(match)) for p in parts]), question)
    return Found(rows, distinct_sources(tables, tables))


def identifier_search(tables: Tables, question: str) -> Found:
    """Rows of all tables that hold the first identifier of the question."""
    targets = identifier_targets(tables, question)[:1]
    parts = [of_identifiers(sourced(t), targets).withColumn("_identifier", F.lit(targets[0])) for t in tables.values() if targets and identifier_columns(t.frame.columns)]
    return found_rows(parts, tables, question, "identifier_exact_match")


def cohort_search(tables: Tables, question: str) -> Found:
    """Rows of all tables of the cohort that a question names."""
    has = lambda t: set(t.frame.columns) & {*COHORT_COLUMNS, *COHORT_NAMES}
    parts = [of_cohort(sourced(t), question) for t in tables.values() if cohort_of(question) and has(t)]
    return found_rows(parts, tables, question, "cohort_exact_match")


def lookup_phrase(question: str) -> str:
    """A question without its request and amount words at the end, taken off until nothing changes."""
    out, before = re.sub(r"[?？!！。.,，]+$", "", question.strip()).strip(), None
    while out and out != before:
        before, out = out, ENDING.sub("", out).strip()
    return re.sub(r"\s+", " ", out)


def display_name(columns: list[str]) -> Column:
    """The first of the display columns whose cell has a lookup key."""
    parts = [F.when(F.coalesce(names.lookup_key(F.col(c)), F.lit("")) != "", text(c)) for c in DISPLAY_COLUMNS if c in columns]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def may_be_organisation(columns: list[str]) -> Column:
    """Rows with a name to show that aren't known to be people."""
    person = [F.coalesce(names.lookup_key(F.col("성명_검색키")), F.lit("")) != ""] if "성명_검색키" in columns else []
    person += [F.coalesce(F.lower("entity_type").rlike(r"^person(?:_|$)"), F.lit(False))] if "entity_type" in columns else []
    return display_name(columns).isNotNull() & ~reduce(lambda a, b: a | b, person, F.lit(False))


def organisation_rows(tables: Tables, question: str) -> Found:
    """Rows of the organisation that fits the question's phrase best over all tables: equal, at the end, contained; none where several names fit."""
    phrase = lookup_phrase(question)
    key = names.lookup_key(F.lit(phrase))
    parts = []
    for table in tables.values():
        rows = sourced(table)
        rows = rows.where(may_be_organisation(rows.columns)).withColumn("_display", display_name(rows.columns))
        stored = names.lookup_key(F.col("_display"))
        rank = F.when(stored == key, 0).when(F.endswith(stored, key), 1).when((F.length(key) >= 3) & F.contains(stored, key), 2)
        parts.append(rows.withColumns({"_rank": rank, "_key": stored}).where("_rank IS NOT NULL"))
    if len(phrase) < 2 or not parts:
        return Found(notice=Notice("empty", "조건에 맞는 데이터가 없습니다"))
    whole = written(together(parts), "organisations")
    best = whole.groupBy("_rank").agg(F.countDistinct("_key").alias("__n")).orderBy("_rank").limit(1).where("__n = 1").select(F.col("_rank").alias("__best"))
    match = F.when(F.col("_rank") == 0, "organization_exact_match").otherwise("organization_partial_match")
    rows = whole.join(F.broadcast(best), F.col("_rank") == F.col("__best")).withColumn("_match", match).drop("__best", "_key")
    return Found(of_last_year(of_cohort(rows, question), question), distinct_sources(tables, tables))


def name_words(question: str) -> list[str]:
    """Names that a question may mean: masked ones, then words of two to five letters."""
    found = [m[0] for m in re.finditer(r"[가-힣]\s*[*＊○●Oo0xX×]\s*[가-힣*＊○●Oo0xX×]{0,3}", question)]
    found += re.findall(r"[가-힣]{2,5}", question)
    cleaned = [re.sub(r"\s+", "", re.sub(f"[{names.MASKS}]", "*", bare(w))) for w in found]
    return list(dict.fromkeys(c for c in cleaned if c and c not in NO_VALUES))


def masked_text(name: str) -> str:
    """A name of three to five letters with stars between the first and the last."""
    return f"{name[0]}{'*' * (len(name) - 2)}{name[-1]}" if re.fullmatch(r"[가-힣]{3,5}", name) else name


#: Classes of name matches, the best first.
MATCHES = ("exact_match", "masked_direct_match", "masked_candidate_match", "fallback_name_match")


def name_parts(table: TableRef) -> dict | None:
    """A table's search key if it has one, and its names, their masks and whether they are hidden, as columns; None without names."""
    columns = table.frame.columns
    plain = next((c for c in columns if c in NAME_COLUMNS), None)
    key = "성명_검색키" if "성명_검색키" in columns else None
    if key is None and plain is None:
        return None
    stored = names.person_name(F.col(key or plain))
    pattern = names.person_name(F.col("성명_마스킹패턴")) if "성명_마스킹패턴" in columns else names.masked_form(stored) if key else F.lit(None).cast("string")
    hidden = F.col("성명_마스킹여부").cast("boolean") if "성명_마스킹여부" in columns else names.is_masked(F.col(key)) if key else F.lit(False)
    return {"key": key, "stored": stored, "pattern": pattern, "hidden": hidden}


def index_names(index: NameIndex, tables: Tables) -> None:
    """List the names of all tables with a search key."""
    for alias, table in tables.items():
        parts = name_parts(table)
        if parts and parts["key"]:
            index.put(alias, table.frame.select(F.col(POSITION).cast("long").alias("position"), parts["stored"].alias("stored"), parts["pattern"].alias("pattern")))


def name_matches(table: TableRef, candidates: list[str], valid: Column, near: DataFrame | None = None) -> DataFrame | None:
    """Rows of a table that match one of the names, with class, distance and the name; a row counts for its best match.

    A masked name asked for matches masked ones at the least distance; a plain one matches itself, else masks that may hide it, the
    nearest first, of rows with a search key (organisations have none); tables without a search key are searched for names that contain it. ``near(source, position)`` names the rows to look at, where an index does.
    """
    rows = sourced(table)
    parts = name_parts(table)
    if parts is None:
        return None
    key = parts["key"]
    if near is not None and key:
        # rows that the index doesn't name can't match
        rows = rows.join(near.where(F.col("source") == table.alias).select(F.col("position").alias("__near")), F.col(POSITION) == F.col("__near"), "left_semi")
    # Each name is normalised once, in a projection of its own.
    rows = rows.withColumns({"__stored": parts["stored"], "__pattern": parts["pattern"], "__hidden": F.coalesce(parts["hidden"], F.lit(False))})
    stored, pattern, hidden = F.col("__stored"), F.col("__pattern"), F.col("__hidden")
    options = []
    for number, name in enumerate(candidates):
        asked = F.lit(name)
        if key is None:
            options.append(F.when(F.contains(stored, asked), F.struct(F.lit(3).alias("class"), F.lit(0).alias("distance"), F.lit(number).alias("name"))))
            continue
        masked = "*" in name
        own, close = stored == asked, names.masked_distance(asked, stored)
        option = F.when(own, F.struct(F.lit(1 if masked else 0).alias("class"), F.lit(0).alias("distance"), F.lit(number).alias("name")))
        if masked:
            option = option.when(close <= 180, F.struct(F.lit(1).alias("class"), close.alias("distance"), F.lit(number).alias("name")))
        else:
            mask = masked_text(name)
            if mask != name:
                near = names.masked_distance(F.lit(mask), pattern)
                option = option.when(hidden & (stored != "") & (near <= 180), F.struct(F.lit(2).alias("class"), near.alias("distance"), F.lit(number).alias("name")))
        options.append(option)
    best = F.array_min(F.array_compact(F.array(*options)))
    return rows.withColumn("__match", best).where(F.col("__match").isNotNull() & valid).drop("__stored", "__pattern", "__hidden")


def name_search(tables: Tables, question: str, index: NameIndex | None = None) -> Found:
    """Rows of all tables of the best class of name match, then of the question's cohort and identifiers.

    Of a table and name only the nearest rows stay, and only those with an amount where the table has amounts.
    """
    candidates = name_words(question)
    near = index.rows_near(sorted({n for c in candidates for n in (c, masked_text(c))})) if index is not None and candidates else None
    parts = []
    for i, table in enumerate(tables.values()):
        amounts = [c for c in table.visible if table.meaning(c).data_type == "money"]
        # stored numbers aren't read as text, which would lose those of ten million and more
        valid = reduce(lambda a, b: a | b, (~F.isnan(F.coalesce(typed(table, c), F.lit(float("nan")))) for c in amounts)) if amounts else F.lit(True)
        rows = name_matches(table, candidates, valid, near) if candidates else None
        if rows is not None:
            parts.append(rows.withColumns({"__of": F.lit(i), "__class": F.col("__match.class"), "__name": F.col("__match.name"), "__far": F.col("__match.distance")}).drop("__match"))
    if not parts:
        return Found(notice=Notice("empty", "조건에 맞는 이름을 찾지 못했습니다"))
    whole = written(together(parts), "names")  # few rows, which are read three times
    nearest = whole.groupBy("__of", "__name").agg(F.min(F.struct("__class", "__far")).alias("__near"))
    best = whole.agg(F.min("__class").alias("__best"))
    kept = whole.join(F.broadcast(nearest), ["__of", "__name"]).join(F.broadcast(best))
    kept = kept.where((F.col("__class") == F.col("__best")) & (F.struct("__class", "__far") == F.col("__near")))
    match = F.element_at(F.array(*map(F.lit, MATCHES)), F.col("__class") + 1)
    asked = F.element_at(F.array(*map(F.lit, candidates)), F.col("__name") + 1)
    rows = kept.withColumns({"_match": match, "_asked": asked}).drop("__of", "__name", "__class", "__far", "__near", "__best")
    rows = of_cohort(of_last_year(rows, question), question)
    return Found(of_identifiers(rows, identifier_targets(tables, question)), distinct_sources(tables, tables))


@dataclass(frozen=True)
class Span:
    """Months with or without years; without years they count where the table has one year, or in all years if asked so."""

    start: tuple[int | None, int]
    end: tuple[int | None, int]
    every_year: bool = False

    def label(self, only: int | None = None) -> str:
        (y1, m1), (y2, m2) = self.start, self.end
        if y1 is not None:
            return f"{y1}년 {m1}월" if self.start == self.end else f"{y1}년 {m1}월~{y2}년 {m2}월"
        months = f"{m1}월" if m1 == m2 else f"{m1}~{m2}월"
        return f"모든 연도의 {months}" if self.every_year else f"{only}년 {months}" if only else months


def date_parts(table: TableRef, question: str) -> tuple[str, Column | None, Column, Column] | Notice:
    """The date column that a question means, and year, month and validity of its rows."""
    meanings = {c: table.meaning(c) for c in table.visible}
    found = [c for c, m in meanings.items() if m.data_type == "date" or m.role == "month"]
    named = [c for c in found if c in question]
    dated = [c for c in found if meanings[c].data_type == "date"]
    pick = named if len(named) == 1 else found if len(found) == 1 else dated if len(dated) == 1 else []
    if not found:
        return Notice("clarification", "이 문서에는 날짜로 판단할 수 있는 컬럼이 없습니다", (table.source,))
    if not pick:
        return Notice("clarification", f"날짜 기준을 하나로 결정할 수 없습니다. 사용할 날짜 컬럼을 지정해 주세요: {', '.join(found)}", (table.source,))
    column = pick[0]
    if meanings[column].data_type == "date":
        stored = table.frame.schema[column].dataType.simpleString()
        at = F.col(f"`{column}`") if stored.startswith(("timestamp", "date")) else to_timestamp(F.col(f"`{column}`"))
        return column, F.year(at), F.month(at), at.isNotNull()
    months = component(F.col(f"`{column}`"))
    year = next((c for c, m in meanings.items() if m.role == "year"), None)
    years = component(F.col(f"`{year}`")) if year else None
    valid = months.between(1, 12) & (years.between(1900, 2100) if years is not None else F.lit(True))
    return column, years, months, F.coalesce(valid, F.lit(False))


def dated_rows(table: TableRef, span: Span, question: str) -> tuple[DataFrame, DataFrame] | Notice:
    """Rows within a span, and one row of evidence: column, matched and invalid rows, first and last year.

    Without years a table of several years asks back unless all years are meant: the only job that is run here.
    """
    parts = date_parts(table, question)
    if isinstance(parts, Notice):
        return parts
    column, years, months, valid = parts
    if span.start[0] is not None and years is None:
        return Notice("clarification", f"{column} 컬럼에는 월 정보만 있어 연도를 구분할 수 없습니다", (table.source,))
    only = None
    if span.start[0] is None and not span.every_year and years is not None:
        low, high = table.frame.where(valid).agg(F.min(years), F.max(years)).collect()[0]
        if low != high:
            return Notice("clarification", "여러 연도의 날짜가 있습니다. 연도를 지정하거나 '모든 연도'라고 질문해 주세요", (table.source,))
        only = low
    inside = valid & F.coalesce(month_range(years if years is not None else F.lit(None).cast("int"), months, span.start, span.end), F.lit(False))
    year = years if years is not None else F.lit(None).cast("int")
    evidence = table.frame.agg(
        F.lit(table.source).alias("source"), F.lit(column).alias("column"), F.lit(span.label(only)).alias("period"), F.count_if(inside).alias("matched_rows"), F.count_if(~valid).alias("invalid_rows"), F.min(F.when(inside, year)).alias("first_year"), F.max(F.when(inside, year)).alias("last_year")
    )
    return table.frame.where(inside), evidence


def date_search(tables: Tables, span: Span, question: str, expression: str = "", *, selected: bool = False) -> Found:
    """Rows of all tables within a span that also fulfil the rest of the question: words of cells, identifiers, cohort, people only.

    ``expression`` is the part of the question that names the span, so its years aren't looked up again. Rows of several documents are put together only where
    those are ``selected``.
    """
    rest = question.replace(expression, " ", 1) if expression else question
    conditions = cell_conditions(tables, rest)
    targets = identifier_targets(tables, question)
    parts, evidence, notices, aliases = [], [], [], []
    for alias, table in tables.items():
        if conditions and alias not in conditions:
            continue
        found = dated_rows(table, span, question)
        if isinstance(found, Notice):
            notices.append(found)
            continue
        rows = of_cohort(of_identifiers(fulfil(sourced(table, found[0]), conditions.get(alias, [])), targets), question)
        if PEOPLE.search(question):
            rows = known_people(rows)
        parts.append(rows)
        evidence.append(found[1])
        aliases.append(alias)
    if not parts:
        return Found(notice=notices[0] if notices else Notice("empty", "조건에 맞는 날짜 데이터가 없습니다"))
    sources = distinct_sources(tables, aliases)
    if len(sources) > 1 and not selected:
        return choose("날짜 조건을 적용할 문서를 선택해주세요", sources)
    return Found(together(parts), sources, evidence=reduce(DataFrame.unionByName, evidence))


def known_people(rows: DataFrame) -> DataFrame:
    """People, where any row is classified; else all rows."""
    if "entity_type" not in rows.columns:
        return rows
    kind = F.lower(F.coalesce("entity_type", F.lit("")))
    some = rows.agg(F.coalesce(F.bool_or(kind.rlike(r"^(?:person|organization|department)(?:_|$)")), F.lit(False)).alias("__some"))
    return rows.join(F.broadcast(some), kind.rlike(r"^person(?:_|$)") | ~F.col("__some")).drop("__some")


def person_list(rows: DataFrame) -> DataFrame:
    """One row for each person, the first by source and position, in the columns of a list of people."""
    key = next((c for c in IDENTITY_COLUMNS if c in rows.columns), None)
    if key is None:
        return rows
    keyed = rows.withColumn("__key", names.person_name(F.col(key))).where("__key <> ''")
    order = F.struct(F.col(SOURCE) if SOURCE in rows.columns else F.lit(""), F.col(POSITION))
    shown = [c for c in LIST_COLUMNS if c in rows.columns] or [c for c in rows.columns if not c.startswith("_")]
    return keyed.groupBy("__key").agg(F.min_by(F.struct(*shown), order).alias("__row")).select("__row.*")


def payee(tables: Tables) -> DataFrame:
    """The first cell that isn't blank of the first table with a column of payees."""
    for table in tables.values():
        column = next((c for c in table.frame.columns if "지급처" in c), None)
        if column:
            cell = names.blank_to_null(F.col(f"`{column}`"))
            return table.frame.agg(F.min_by(cell, F.when(cell.isNotNull(), F.col(POSITION))).alias("payee"))
    return next(iter(tables.values())).frame.agg(F.lit(None).cast("string").alias("payee"))


def valid_name_rows(rows: DataFrame) -> DataFrame:
    """How many rows have a name; all rows where there is no column of names, or none has one."""
    column = next((c for c in rows.columns if c in NAME_COLUMNS), None)
    if column is None:
        return rows.agg(F.count("*").alias("n"))
    named = ~F.coalesce(F.trim(text(column)), F.lit("")).isin("", "None", "nan", "NaN")
    return rows.agg(F.when(F.count_if(named) > 0, F.count_if(named)).otherwise(F.count("*")).alias("n"))


def entity_seed(name: Column, candidate: Column | None = None, contacts: list[Column] | None = None) -> Column:
    """What a person's id is made of: candidate key and name, else name and contacts, else the name."""
    shown = names.person_name(name)
    held = F.array_sort(F.array_compact(F.array(*(F.regexp_replace(F.lower(names.blank_to_null(c)), r"[\s\-().]", "") for c in contacts or []))))
    parts = [F.when(names.blank_to_null(candidate).isNotNull(), F.concat_ws("|", F.lit("candidate"), names.blank_to_null(candidate), shown))] if candidate is not None else []
    parts.append(F.when(F.size(held) > 0, F.concat_ws("|", F.lit("contact"), shown, F.array_join(held, ","))))
    return names.stable_id("entity", F.coalesce(*parts, F.concat_ws("|", F.lit("name"), shown)))
