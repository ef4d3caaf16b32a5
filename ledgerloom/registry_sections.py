"""Registered queries over sections, lexical scans and evidence, and their SQL. Documents are made of customers, the same way for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import answers, retrieval, sections
from ledgerloom.registry import read, register, terms_sql

#: A document for each customer: a preface, two or three numbered sections, every third without a preface.
DOCS_SQL = """WITH docs AS (SELECT c_custkey AS k, concat('doc', CAST(c_custkey AS VARCHAR)) AS source,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('머리말입니다. 이 문서는 장학 안내를 위하여 만든 것입니다 ', CAST(c_custkey AS VARCHAR)) END AS preface,
  concat('1. 선발 대상 ', CAST(c_custkey % 7 AS VARCHAR)) AS t0, concat('2. 선발 기준 ', CAST(c_custkey % 5 AS VARCHAR)) AS t1, CASE WHEN c_custkey % 2 = 0 THEN '3. 일정' END AS t2,
  concat('대상은 학부 재학생 ', CAST(c_custkey AS VARCHAR), '명이며 휴학생은 빼고 뽑습니다') AS b0, concat('평점은 ', CAST(c_custkey % 4 AS VARCHAR), '.0 이상이어야 하고 모두 충족해야 합니다') AS b1, '접수 기간은 삼월부터 오월까지이며 이후는 받지 않습니다' AS b2
  FROM customer),
parts AS (SELECT k, source, NULL AS i, CAST(NULL AS VARCHAR) AS title, preface AS text FROM docs WHERE preface <> ''
  UNION ALL SELECT k, source, 0, t0, concat(t0, chr(10), b0) FROM docs UNION ALL SELECT k, source, 1, t1, concat(t1, chr(10), b1) FROM docs
  UNION ALL SELECT k, source, 2, t2, concat(t2, chr(10), b2) FROM docs WHERE t2 IS NOT NULL)
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    s = k.cast("string")
    preface = F.when(k % 3 != 0, F.concat(F.lit("머리말입니다. 이 문서는 장학 안내를 위하여 만든 것입니다 "), s, F.lit("\n"))).otherwise("")
    one = F.concat(F.lit("1. 선발 대상 "), (k % 7).cast("string"), F.lit("\n대상은 학부 재학생 "), s, F.lit("명이며 휴학생은 빼고 뽑습니다\n"))
    two = F.concat(F.lit("2. 선발 기준 "), (k % 5).cast("string"), F.lit("\n평점은 "), (k % 4).cast("string"), F.lit(".0 이상이어야 하고 모두 충족해야 합니다"))
    three = F.when(k % 2 == 0, F.lit("\n3. 일정\n접수 기간은 삼월부터 오월까지이며 이후는 받지 않습니다")).otherwise("")
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("doc"), s).alias("source"), F.concat(preface, one, two, three).alias("text"))


def section_query(name: str, sql: str):
    return register(name, DOCS_SQL + sql, ledger_sql=False)


@section_query("text_sections", "SELECT source, CASE WHEN i IS NOT NULL THEN concat('s', CAST(i AS VARCHAR)) END AS section_id, title AS section_title, CAST(i AS INT) AS section_index, 1 AS child_count, 0 AS child_index, text FROM parts")
def _(spark, sf_dir):
    return sections.text_sections(documents(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document over three pages: page 1 opens a section, page 2 goes on with it, page 3 ends it and opens the next."""
    k = F.col("c_custkey")
    s = k.cast("string")
    texts = F.array(
        F.concat(F.lit("앞에 있는 글은 어느 절에도 속하지 않습니다 그렇습니다\n제1장 지원 대상 안내\n첫째 쪽의 본문은 여기에서 시작하여 끝까지 갑니다 "), s),
        F.concat(F.lit("둘째 쪽에는 제목이 없으므로 앞의 절이 이어집니다 "), s),
        F.concat(F.lit("셋째 쪽의 첫 부분도 앞의 절에 속하는 글이 됩니다\n제2장 지원 절차 안내\n새로운 절의 본문은 여기에서 시작하여 끝까지 갑니다 "), s),
    )
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("doc"), s).alias("source"), F.posexplode(texts).alias("page", "text")).withColumn("page", F.col("page") + 1)


_PAGES = """WITH d AS (SELECT concat('doc', CAST(c_custkey AS VARCHAR)) AS source, CAST(c_custkey AS VARCHAR) AS s FROM customer), rows_ AS (
  SELECT source, 1 AS page, 'p1:s0' AS section_id, '제1장 지원 대상 안내' AS section_title, concat('제1장 지원 대상 안내', chr(10), '첫째 쪽의 본문은 여기에서 시작하여 끝까지 갑니다 ', s) AS text, 0 AS child_index, 3 AS child_count FROM d
  UNION ALL SELECT source, 2, 'p1:s0', '제1장 지원 대상 안내', concat('제1장 지원 대상 안내', chr(10), '둘째 쪽에는 제목이 없으므로 앞의 절이 이어집니다 ', s), 1, 3 FROM d
  UNION ALL SELECT source, 3, 'p1:s0', '제1장 지원 대상 안내', concat('제1장 지원 대상 안내', chr(10), '셋째 쪽의 첫 부분도 앞의 절에 속하는 글이 됩니다'), 2, 3 FROM d
  UNION ALL SELECT source, 3, 'p3:s0', '제2장 지원 절차 안내', concat('제2장 지원 절차 안내', chr(10), '새로운 절의 본문은 여기에서 시작하여 끝까지 갑니다 ', s), 0, 1 FROM d)
"""


@register("page_sections", _PAGES + "SELECT source, page, section_id, section_title, text, child_index, child_count FROM rows_", ledger_sql=False)
def _(spark, sf_dir):
    out = sections.page_sections(pages(spark, sf_dir))
    return out.withColumn("child_count", F.col("child_count").cast("int"))


@register("section_list", _PAGES + "SELECT source, section_id, section_title AS title, min(page) AS start_page, max(page) AS end_page, count(*) AS chunk_count FROM rows_ GROUP BY ALL", ledger_sql=False)
def _(spark, sf_dir):
    return sections.section_list(sections.page_sections(pages(spark, sf_dir)))


@register("renumbered_children", "SELECT concat('c', CAST(conv_id AS VARCHAR)) AS section_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS INT) AS child_index, count(*) OVER (PARTITION BY conv_id) AS child_count FROM conversations", ledger_sql=False)
def _(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("section_id"), "turn", (-F.col("turn")).alias("back"))
    return sections.renumbered(c, ["back"]).select("section_id", "turn", F.col("child_index").cast("int").alias("child_index"), "child_count")


@section_query("merged_items", "SELECT source, 0 AS section_index, t0 AS section_title, concat('□ 지원 대상 ', CAST(k % 7 AS VARCHAR), chr(10), b0) AS text FROM docs UNION ALL SELECT source, 1, t1, concat('■ 성적 기준', chr(10), b1, chr(10), chr(10), '◇ 그 밖에', chr(10), '끝') FROM docs UNION ALL SELECT source, 2, '3. 일정', '표에서 온 글' FROM docs")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    s, source = k.cast("string"), F.concat(F.lit("doc"), k.cast("string"))
    top = F.array(*(F.struct(F.concat(F.lit(t), more).alias("section_title"), F.lit(b).alias("text")) for t, more, b in (("1. 선발 대상 ", (k % 7).cast("string"), "표"), ("2. 선발 기준 ", (k % 5).cast("string"), "표"), ("3. 일정", F.lit(""), "표에서 온 글"))))
    tops = read(spark, sf_dir, "customer").select(source.alias("source"), F.posexplode(top).alias("section_index", "x")).select("source", "section_index", "x.*")
    body = (F.concat(F.lit("□ 지원 대상 "), (k % 7).cast("string"), F.lit("\n대상은 학부 재학생 "), s, F.lit("명이며 휴학생은 빼고 뽑습니다")), F.concat(F.lit("■ 성적 기준\n평점은 "), (k % 4).cast("string"), F.lit(".0 이상이어야 하고 모두 충족해야 합니다")), F.lit("◇ 그 밖에\n끝"))
    items = F.array(*(F.struct(F.substring_index(b, "\n", 1).alias("title"), b.alias("text")) for b in body))
    lower = read(spark, sf_dir, "customer").select(source.alias("source"), F.posexplode(items).alias("item_index", "x")).select("source", "item_index", "x.*")
    return sections.merged_items(tops, lower)


@section_query("suggested_titles", "SELECT source, 1 AS place, t0 AS title FROM docs UNION ALL SELECT source, 2, t1 FROM docs")
def _(spark, sf_dir):
    return sections.suggested_titles(sections.text_sections(documents(spark, sf_dir)).where("section_id IS NOT NULL").select("source", "section_index", F.col("section_title").alias("title")))


@section_query("document_structure", "SELECT source, 'pdf' AS file_type, count(*) AS chunk_count, 3 AS page_count, count(i) AS section_count, 0 AS table_count, 'sectioned_document' AS document_type, 'semantic_question,list_sections,read_section,summarize_section' AS capabilities FROM parts GROUP BY source")
def _(spark, sf_dir):
    records = sections.text_sections(documents(spark, sf_dir)).withColumns({"file_type": F.lit("PDF"), "page": F.lit(3), "table_id": F.lit(None).cast("string")})
    return sections.document_structure(records).withColumn("capabilities", F.array_join("capabilities", ","))


_TEXT, _TITLE, _ASKED = (terms_sql(c) for c in ("d.text", "d.title", "q.text"))


@register(
    "lexical_scan",
    f"WITH d AS (SELECT doc_id, text, split_part(text, ' ', 1) AS title FROM documents), q AS (SELECT item_id, text FROM benchmark), s AS (SELECT q.item_id AS query, d.doc_id AS chunk_id, round(len(list_intersect({_ASKED}, {_TEXT})) / len({_ASKED}), 6) AS overlap, round(len(list_intersect({_ASKED}, {_TITLE})) / len({_ASKED}), 6) AS title_overlap FROM d, q WHERE len({_ASKED}) > 0) SELECT * FROM s WHERE overlap >= 0.3 OR title_overlap >= 0.25",
    ledger_sql=False,
)
def _(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.substring_index("text", " ", 1).alias("section_title"))
    found = answers.lexical_scan(chunks, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"))
    return found.select("query", "chunk_id", F.round("overlap", 6).alias("overlap"), F.round("title_overlap", 6).alias("title_overlap"))


def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.text_sections(documents(spark, sf_dir)).select(F.concat_ws(":", "source", F.coalesce("section_id", F.lit("-"))).alias("chunk_id"), "text", "section_title", "section_id")


_CHUNK = "concat(source, ':', CASE WHEN i IS NULL THEN '-' ELSE concat('s', CAST(i AS VARCHAR)) END) AS chunk_id"


@section_query("mandatory_evidence", f"SELECT {_CHUNK} FROM parts WHERE i = 1")
def _(spark, sf_dir):
    return answers.mandatory_evidence(section_chunks(spark, sf_dir), "성적 기준만 맞으면 무조건 되나요").select("chunk_id")


@section_query("mandatory_evidence_not_asked", f"SELECT {_CHUNK} FROM parts")
def _(spark, sf_dir):
    return answers.mandatory_evidence(section_chunks(spark, sf_dir), "접수는 언제인가요").select("chunk_id")


@section_query("missing_evidence", "SELECT CASE WHEN count(*) FILTER (regexp_matches(text, '이유|사유|원인|때문|근거|배경')) = 0 THEN '관련 내역은 확인되지만, 그 이유나 사유는 문서에 명시되어 있지 않습니다.' END AS message FROM parts")
def _(spark, sf_dir):
    return answers.missing_evidence(section_chunks(spark, sf_dir), "왜 이 기준으로 뽑나요")


@section_query("missing_evidence_held", "SELECT CASE WHEN count(*) FILTER (regexp_matches(text, '절차|방법|서류|신청|제출|접수|문의|심사')) = 0 THEN 'missing' END AS message FROM parts")
def _(spark, sf_dir):
    return answers.missing_evidence(section_chunks(spark, sf_dir), "접수 방법을 알려줘")


@section_query("mandatory_clauses", f"SELECT {_CHUNK}, b1 AS clause FROM parts JOIN docs USING (k, source) WHERE i = 1")
def _(spark, sf_dir):
    from ledgerloom.operators import evidence

    return evidence.clauses(section_chunks(spark, sf_dir), "mandatory")


@register("scope_clauses", "SELECT c_custkey AS chunk_id, concat('지원 대상: 학부 재학생 ', CAST(c_custkey % 9 AS VARCHAR), '명') AS clause FROM customer WHERE c_custkey % 2 = 0", ledger_sql=False)
def _(spark, sf_dir):
    from ledgerloom.operators import evidence

    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("안내\n지원 대상: 학부 재학생 "), (k % 9).cast("string"), F.lit("명\n끝"))).otherwise("지원하지 않음")
    return evidence.clauses(read(spark, sf_dir, "customer").select(k.alias("chunk_id"), text.alias("text")), "scope")


@register("preference_is_not_exclusion", "SELECT c_custkey AS chunk_id, '휴학생은 제외한다' AS clause FROM customer WHERE c_custkey % 3 = 1", ledger_sql=False)
def _(spark, sf_dir):
    from ledgerloom.operators import evidence

    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "다자녀 가구를 우대하고 나머지는 제외하지 않는다").when(k == 1, "휴학생은 제외한다").otherwise("안내문")
    return evidence.clauses(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), text.alias("text")), "exclusion")


@register("exceptions", "SELECT c_custkey AS chunk_id, concat('다만 ', CAST(c_custkey AS VARCHAR), '학번은 예외로 한다') AS clause FROM customer WHERE c_custkey % 4 = 0", ledger_sql=False)
def _(spark, sf_dir):
    from ledgerloom.operators import evidence

    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("모두 추천한다\n다만 "), k.cast("string"), F.lit("학번은 예외로 한다"))).otherwise("모두 추천한다")
    return evidence.exceptions(read(spark, sf_dir, "customer").select(k.alias("chunk_id"), text.alias("text")))


@register("table_alignment", "SELECT c_custkey AS chunk_id, concat('1구간 = ', CAST(c_custkey % 50 AS VARCHAR), '점, 2구간 = 20점, 3구간 = 10점') AS note FROM customer WHERE c_custkey % 3 = 0", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("1구간 2구간 3구간\n소득 기준\n반영점수 "), (k % 50).cast("string"), F.lit(" 20 10"))).otherwise("1구간 2구간 3구간\n점수 없음")
    return answers.aligned_tables(read(spark, sf_dir, "customer").select(k.alias("chunk_id"), text.alias("text")))


@register("numeric_evidence", "SELECT c_custkey AS chunk_id FROM customer WHERE c_custkey % 6 = 0", ledger_sql=False)
def _(spark, sf_dir):
    from ledgerloom.operators import evidence

    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, F.concat(F.lit("평점 "), (k % 4).cast("string"), F.lit(".0 이상"))).when(k % 2 == 0, "평점이 높아야 한다").otherwise("안내문")
    return evidence.numeric_evidence(read(spark, sf_dir, "customer").select(k.alias("chunk_id"), text.alias("text")), "평점").select("chunk_id")


@register("evidence_list", "SELECT source, page, section_id, min(chunk_id) AS chunk_id FROM (SELECT concat('s', CAST(c_nationkey AS VARCHAR)) AS source, c_custkey % 3 AS page, concat('x', CAST(c_custkey % 2 AS VARCHAR)) AS section_id, c_custkey AS chunk_id FROM customer) GROUP BY ALL", ledger_sql=False)
def _(spark, sf_dir):
    from ledgerloom.operators import evidence

    k = F.col("c_custkey")
    return evidence.evidence_list(read(spark, sf_dir, "customer").select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("source"), (k % 3).alias("page"), F.concat(F.lit("x"), (k % 2).cast("string")).alias("section_id"), k.alias("chunk_id")))


@register(
    "source_coverage",
    "WITH b AS (SELECT c_nationkey AS source, c_custkey % 4 AS query, max(c_acctbal) AS score FROM customer GROUP BY ALL) SELECT query, source, round(score, 2) AS score FROM b",
    ledger_sql=False,
)
def _(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("query"), F.col("c_nationkey").alias("source"), F.col("c_custkey").alias("chunk_id"), F.col("c_acctbal").alias("score"))
    best = retrieval.best_per(c, ["query", "source"])
    found = best.where("source % 2 = 0")
    return answers.coverage(found, best.select(*found.columns)).select("query", "source", F.round("score", 2).alias("score"))
