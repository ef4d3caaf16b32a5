"""Registered queries over cells, names, headings and small results, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates, names
from ledgerloom.operators import clean, identity, retrieval, schema
from ledgerloom.plans import results
from ledgerloom.plans.execute import exact_median, typed
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef
from ledgerloom.registry import NAME_SQL, ledger_frame, made_names, read, register
from ledgerloom.sources import catalog, sheets
from ledgerloom.sources.profiles import StoredProfiles
from ledgerloom.sources.snapshots import SnapshotStore
from ledgerloom.sources.store import new_folder


@register("year_series", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CAST(2000 + o_orderkey % 30 AS INT) ELSE CAST(year(o_orderdate) AS INT) END AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    year = F.when(k % 5 == 0, "모름").when(k % 2 == 0, F.concat((k % 30 + 2000).cast("string"), F.lit("년"))).otherwise(" ")
    date = F.when(k % 5 != 0, F.col("o_orderdate"))
    return read(spark, sf_dir, "orders").select(k.alias("key"), dates.year_of(date, year).alias("y"), dates.month_of(F.col("o_orderdate"), F.lit("")).alias("m"))


@register("person_shapes", f"SELECT c_custkey AS key, c_custkey % 4 < 2 AS person FROM customer WHERE length({NAME_SQL}) = 3", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey") % 4
    cell = F.when(k == 0, F.col("name")).when(k == 1, names.mask_pattern(F.col("name"))).when(k == 2, "김철수와 이영희 그리고").otherwise("Kim 12")
    return made_names(spark, sf_dir).select(F.col("c_custkey").alias("key"), names.is_person(cell).alias("person"))


@register("source_names", "SELECT c_custkey AS key, c_custkey * 10000 AS amount, CAST(c_custkey % 12 + 1 AS INT) AS month FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat((k % 12 + 1).cast("string"), F.lit("월 장학금 -"), k.cast("string"), F.lit("만원.pdf"))
    return read(spark, sf_dir, "customer").select(k.alias("key"), names.source_amount(name).alias("amount"), names.source_month(name).alias("month"))


@register("clean_page_text", "SELECT c_custkey AS key, concat('scholarship ', CAST(c_custkey AS VARCHAR), chr(10), chr(10), 'end') AS text FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.lit("scholar-\nship "), k.cast("string"), F.lit("\n\n\n\nend\n 7 \n"))
    return read(spark, sf_dir, "customer").select(k.alias("key"), names.clean_page_text(text).alias("text"))


@register("head_counts", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS department FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    cell = F.concat(F.when(k % 3 == 0, " ").otherwise(F.col("c_mktsegment")), F.lit(" ( "), k.cast("string"), F.lit(" 명 )"))
    return clean.strip_head_count(read(spark, sf_dir, "customer").select(k.alias("key"), cell.alias("department")), ["department"])


@register("identity_columns", f"SELECT c_custkey AS key, 'person' AS kind, {NAME_SQL} AS search_key, concat(left({NAME_SQL}, 1), '*', right({NAME_SQL}, 1)) AS mask, concat('대장.xlsx::표1::row_', CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END, '::', c_mktsegment, '::', {NAME_SQL}) AS uid FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    frame = made_names(spark, sf_dir).withColumn("blank", F.lit(" "))
    out = clean.identity_columns(frame, "name", "대장.xlsx", "표1", ("c_mktsegment", "blank"))
    return out.select(F.col("c_custkey").alias("key"), F.col("_entity_type").alias("kind"), F.col("_search_key").alias("search_key"), F.col("_mask_pattern").alias("mask"), F.col("_row_uid").alias("uid"))


@register("candidate_keys", f"SELECT c_custkey AS key, concat(left({NAME_SQL}, 1), '*', right({NAME_SQL}, 1), CASE WHEN c_custkey % 2 = 0 THEN concat('::', c_mktsegment) ELSE '' END) AS candidate FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    return made_names(spark, sf_dir).select(k.alias("key"), clean.candidate_key(names.mask_pattern(F.col("name")), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("  ")).alias("candidate"))


@register("column_meanings", "SELECT * FROM (VALUES ('성명', 'person', 'string'), ('지급액', 'amount', 'money'), ('지급일자', 'date', 'date'), ('학과', 'department', 'string'), ('연락처', 'phone', 'string'), ('발행번호', 'identifier', 'string'), ('비고', 'note', 'string')) t(\"column\", role, kind)", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    frame = made_names(spark, sf_dir).select(
        POSITION, F.col("name").alias("성명"), F.format_number(k * 1000, 0).alias("지급액"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd").alias("지급일자"), F.col("c_mktsegment").alias("학과"), F.concat(F.lit("010-1234-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("연락처"), F.concat(F.lit("A-"), k.cast("string")).alias("발행번호"), F.lit("없음").alias("비고"),
    )
    return spark.createDataFrame([(c, m.role, m.data_type) for c, m in schema.infer(frame).items()], "column string, role string, kind string")


_AMOUNTS = {
    "지급액(원)": ("KRW", 1, "payment", "CAST(c_custkey AS VARCHAR)"), "지급액 (만원)": ("KRW_10000", 10_000, "payment", "CAST(c_custkey % 90 AS VARCHAR)"), "장학금[천원]": ("KRW_1000", 1_000, "scholarship", "CAST(c_custkey % 70 AS VARCHAR)"),
    "출연금액{ KRW }": ("KRW", 1, "donation", "concat(CAST(c_custkey % 50 AS VARCHAR), '000')"), "집행액（만원）": ("KRW_10000", 10_000, "executed", "CAST(c_custkey % 30 AS VARCHAR)"), "사업비": ("KRW", 1, None, "CAST(c_custkey % 20 AS VARCHAR)"),
}


@register("amount_headers", " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{unit}' AS unit, {f"'{q}'" if q else "CAST(NULL AS VARCHAR)"} AS qualifier, CAST(sum(CAST({value} AS DOUBLE) * {times}) AS DOUBLE) AS total FROM customer""" for c, (unit, times, q, value) in _AMOUNTS.items()), ledger_sql=False)
def _(spark, sf_dir):
    """Amount columns by their headers, with a unit in brackets, and the sums that plans make of them."""
    k = F.col("c_custkey")
    value = {"지급액(원)": k, "지급액 (만원)": k % 90, "장학금[천원]": k % 70, "출연금액{ KRW }": k % 50 * 1000, "집행액（만원）": k % 30, "사업비": k % 20}
    frame = read(spark, sf_dir, "customer").select(k.alias(POSITION), *(v.cast("string").alias(c) for c, v in value.items()), F.col("c_mktsegment").alias("학과"))
    meanings = schema.infer(frame)
    table = TableRef("df0", "sheet.xlsx", frame, meanings)
    sums = [F.struct(F.lit(c).alias("column"), F.lit(m.unit).alias("unit"), F.lit(m.qualifier).cast("string").alias("qualifier"), F.sum(typed(table, c)).alias("total")) for c, m in meanings.items() if m.role == "amount"]
    return frame.agg(F.array(*sums).alias("x")).select(F.inline("x"))


@register("kept_profiles", "SELECT '값' AS \"column\", 'KRW_10000' AS unit, count(*) AS n_rows, CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_nationkey END) * 10000.0 AS DOUBLE) AS total FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    """A column that was corrected to an amount once is one in a later table of the same columns, read by another process."""
    k, customer, folder = F.col("c_custkey"), read(spark, sf_dir, "customer"), new_folder(spark, "profiles")
    first = customer.select(k.alias(POSITION), F.col("c_nationkey").cast("string").alias("값"), F.col("c_mktsegment").alias("부서"))
    profiles = StoredProfiles(spark, folder)
    profiles.correct(profiles.of(first), {"값": ColumnMeaning("amount", "amount", "money", "KRW_10000")})
    later = customer.select(k.alias(POSITION), F.when(k % 3 == 0, k).otherwise(F.col("c_nationkey")).cast("string").alias("값"), F.col("c_name").alias("부서"))
    meanings = StoredProfiles(spark, folder).of(later)
    table = TableRef("df1", "later.xlsx", later, meanings)
    sums = [F.struct(F.lit(c).alias("column"), F.lit(m.unit).alias("unit"), F.count("*").alias("n_rows"), F.sum(typed(table, c)).alias("total")) for c, m in meanings.items() if m.role == "amount"]
    return later.agg(F.array(*sums).alias("x")).select(F.inline("x"))


@register("entity_groups", "SELECT nullif(trim(memo), '') AS memo, kind, count(*) AS n_rows, round(sum(amount), 2) AS total, min(pos) AS first_row FROM ledger GROUP BY ALL")
def _(spark, sf_dir):
    return results.entity_groups(ledger_frame(spark, sf_dir), ["memo", "kind"], F.col("amount")).withColumn("total", F.round("total", 2))


@register("payment_breakdown", "SELECT CAST(floor(amount / 1000) AS BIGINT) AS amount, count(*) AS times, min(pos) AS first_row FROM ledger GROUP BY ALL")
def _(spark, sf_dir):
    return results.payment_breakdown(ledger_frame(spark, sf_dir), F.floor(F.col("amount") / 1000))


@register("payment_breakdown_few", "SELECT amount, 1 AS times, pos AS first_row FROM (SELECT * FROM ledger ORDER BY pos LIMIT 5)")
def _(spark, sf_dir):
    rows = ledger_frame(spark, sf_dir)
    return results.payment_breakdown(rows.orderBy(POSITION).limit(5), F.col("amount"))  # five payments are what the rule is about


@register("payment_history", "SELECT person AS entity, kind, cohort, count(*) AS times, min(pos) AS first_row FROM ledger GROUP BY ALL")
def _(spark, sf_dir):
    return identity.payment_history(ledger_frame(spark, sf_dir), F.col("person"), ["kind", "cohort"])


@register("list_preview", "SELECT department, person, pos FROM ledger ORDER BY department, person, pos LIMIT 200")
def _(spark, sf_dir):
    rows = ledger_frame(spark, sf_dir).withColumn("source", F.col("department"))
    return results.preview(rows, "person")[0].select("department", "person", F.col(POSITION).alias("pos"))


@register("median_by_ranks", "SELECT median(l_extendedprice) AS value FROM lineitem", ledger_sql=False)
def _(spark, sf_dir):
    return exact_median(read(spark, sf_dir, "lineitem"), F.col("l_extendedprice"))


@register("overview_chunk", "SELECT concat('[문서 개요] 고객', chr(10), '파일: customer.xlsx', chr(10), '행 수: ', CAST(count(*) AS VARCHAR), chr(10), '금액 합계: ', format('{:,}', CAST(sum(c_custkey) * 1000 AS BIGINT)), '원', chr(10), '열: c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment', chr(10), '용도: 고객 목록') AS chunk_text FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    return retrieval.overview_text(read(spark, sf_dir, "customer"), "고객", "customer.xlsx", "고객 목록", F.col("c_custkey") * 1000)


@register("headings", "SELECT c_custkey AS key, CAST(i AS INT) AS heading_index, CASE i WHEN 0 THEN '제1장 총칙 안내' WHEN 1 THEN '1.2. 선발 기준' ELSE 'IV. 부칙 사항' END AS heading FROM customer, range(3) t(i)", ledger_sql=False)
def _(spark, sf_dir):
    text = F.lit("머리말\n제1장 총칙 안내\n본문 1. 아님\n1.2. 선발 기준\n본문\nIV. 부칙 사항")
    return retrieval.headings(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), text.alias("text")))


@register("continued_sections", "SELECT conv_id AS source, turn AS page, CASE WHEN turn >= 2 THEN concat('s', CAST(turn - turn % 2 AS VARCHAR)) END AS section_id FROM conversations WHERE turn = turn", ledger_sql=False)
def _(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("page"), F.when((F.col("turn") % 2 == 0) & (F.col("turn") >= 2), F.concat(F.lit("s"), F.col("turn").cast("string"))).alias("section_id"))
    return retrieval.continue_sections(c)


@register("explicit_title", "SELECT s_suppkey AS key FROM supplier WHERE s_suppkey = 7", ledger_sql=False)
def _(spark, sf_dir):
    titles = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.lit("제"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0"), F.lit("조 신청 방법")).alias("title"))
    return retrieval.title_documents(titles, "제0007조 신청 방법을 알려줘").select("key")


@register("file_kinds", "SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN 'sheets' WHEN 1 THEN 'pages' WHEN 2 THEN 'packed' WHEN 3 THEN 'images' ELSE 'none' END AS kind FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    ends = F.element_at(F.array(*map(F.lit, ("xlsx", "PDF", "hwpx", "Jpeg", "txt"))), (k % 5).cast("int") + 1)
    return read(spark, sf_dir, "customer").select(k.alias("key"), sheets.file_kind(F.concat(F.lit("/in/v1.0/a."), ends)).alias("kind"))


@register("dispatch_states", "SELECT concat('f', CAST(c_custkey AS VARCHAR), '.pdf') AS source, CASE WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 4 = 1 THEN 'again' WHEN c_custkey % 3 = 0 THEN 'again' ELSE 'current' END AS state FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    base = read(spark, sf_dir, "customer").select(F.concat(F.lit("f"), k.cast("string"), F.lit(".pdf")).alias("source"), k)
    files = base.select("source", F.concat(F.lit("/in/"), "source").alias("path"), F.lit("h").alias("file_hash"), F.lit(b"").alias("content"))
    manifest = base.select("source", F.when(k % 4 == 0, "old").otherwise("h").alias("file_hash"), F.lit("SUCCESS").alias("status"), F.lit("2.4").alias("schema_version"), F.lit(2).alias("n_chunks"))
    chunks = base.select("source", F.when(k % 3 == 0, "1").otherwise("2").alias("parser_version"), F.explode(F.sequence(F.lit(1), F.when(k % 4 == 1, 1).otherwise(2))).alias("i"))
    return sheets.dispatch(files, manifest, chunks, "2.4", {}, {"pages": "2"})[0].select("source", "state")


@register("recognition_quality", "SELECT count(*) FILTER (c_custkey % 7 = 0) AS empty_rows, count(*) FILTER (c_custkey % 5 = 0) AS uncertain_rows, CAST(sum(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey * 1000 END) AS BIGINT) AS calculated_total FROM customer", ledger_sql=False)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    cell = lambda c: F.when(k % 7 != 0, c)
    rows = read(spark, sf_dir, "customer").select(cell(F.col("c_name")).alias("name"), cell(F.concat(F.format_number(k * 1000, 0), F.lit("원"))).alias("amount"), F.when(k % 5 == 0, "B2").otherwise(" ").alias("_ocr_low_confidence_cells"))
    return sheets.recognition_quality(rows, ["amount"])[1]


@register("chunk_store", "SELECT source, count(*) AS n_chunks FROM (SELECT concat('s', CAST(conv_id % 10 AS VARCHAR)) AS source FROM conversations WHERE conv_id % 10 NOT IN (3, 4) UNION ALL SELECT 's4' FROM range(7)) GROUP BY source", ledger_sql=False)
def _(spark, sf_dir):
    """Chunks of one source deleted, those of another replaced, and all counted."""
    chunks = read(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), (F.col("conv_id") % 10).cast("string")).alias("source"), "text")
    fresh = spark.range(7).select(F.lit("s4").alias("source"), F.col("id").cast("string").alias("text"))
    return catalog.source_counts(catalog.replace_source(catalog.delete_source(chunks, "s3"), "s4", fresh))


_CHUNKS = "SELECT concat('s', CAST(conv_id % 10 AS VARCHAR)) AS source, conv_id * 100 + turn AS chunk_id, text FROM conversations"


@register(
    "snapshot_store",
    f"WITH one AS ({_CHUNKS}), two AS (SELECT source, chunk_id, concat('new ', text) AS text FROM one WHERE source IN ('s1', 's4') AND chunk_id % 2 = 0 UNION ALL SELECT * FROM one WHERE source NOT IN ('s1', 's3', 's4')) "
    "SELECT 1 AS version, source, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS letters FROM one GROUP BY source UNION ALL SELECT 3, source, count(*), CAST(sum(length(text)) AS BIGINT) FROM two GROUP BY source",
    ledger_sql=False,
)
def _(spark, sf_dir):
    """Chunks of all sources, two of them replaced and one deleted, then compacted; read as of the first version and of the last."""
    chunks = read(spark, sf_dir, "conversations").select(F.concat(F.lit("s"), (F.col("conv_id") % 10).cast("string")).alias("source"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), "text")
    store = SnapshotStore(spark, new_folder(spark, "snapshots"), chunks.schema)
    store.replace(chunks)
    store.replace(chunks.where("source IN ('s1', 's4') AND chunk_id % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text")))
    store.delete(spark.createDataFrame([("s3",)], "source string"))
    store.compact()
    of = lambda version, name: store.read(version).groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("letters")).select(F.lit(name).alias("version"), "source", "n_chunks", "letters")
    return of(1, 1).unionByName(of(4, 3))


@register("manifest_upsert", "SELECT CAST(user_id AS VARCHAR) AS source, CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'old' END AS file_hash FROM (SELECT DISTINCT user_id FROM events)", ledger_sql=False)
def _(spark, sf_dir):
    users = read(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("source"), "user_id")
    old, new = users.select("source", F.lit("old").alias("file_hash")), users.where("user_id % 3 = 0").select("source", F.lit("new").alias("file_hash"))
    return catalog.upsert(old, new)
