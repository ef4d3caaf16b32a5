"""Scalars, cleaning, identity, comparisons, retrieval, sources."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, names
from ledgerloom.functions.money import money
from ledgerloom.operators import clean, identity, retrieval, schema
from ledgerloom.operators.graph import linked_groups
from ledgerloom.plans.table import POSITION, ColumnMeaning
from ledgerloom.sources import catalog, grids
from ledgerloom.streaming.ingest import watch


def apply(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_money(spark):
    good = {"1,000": 1000, "₩1,000원": 1000, "-5만원": -50000, "+3천원": 3000, "2억원": 2e8, " 1000.5 ": 1000.5, "KRW 700": 700, "krw700": 700, "0": 0}
    bad = ["", "-", "none", "1,00", "1만원입니다", "백만원", None, "1 2", "1,0000"]
    assert apply(spark, [*good, *bad], money) == [*good.values(), *[None] * len(bad)]
    assert apply(spark, ["3", "3천원"], lambda c: money(c, "KRW_10000")) == [30000, 3000]


def test_dates(spark):
    texts = ["2025-03-01", "20250301", "2025년 3월 1일", "2025.3.1", "2025/03/01", "45717", "2025-03-01 10:20", "x", None, "99999999"]
    got = apply(spark, texts, lambda c: dates.to_timestamp(c).cast("date").cast("string"))
    assert got == ["2025-03-01"] * 7 + [None] * 3
    assert apply(spark, ["3월", "12", "2025년", "x"], dates.component) == [3, 12, 2025, None]


def test_names(spark):
    assert apply(spark, ["김 철수", "이○호", "추＊철", "nan", None], names.person_name) == ["김철수", "이*호", "추*철", "", None]
    assert apply(spark, ["이*호", "김철수", "**", "abc"], names.is_masked) == [True, False, False, False]
    assert apply(spark, ["김철수", "남궁민수", "이산"], names.mask_pattern) == ["김*수", "남**수", "이산"]
    assert apply(spark, ["주식회사 하나", "경영학과", "49회 김철수", "이*규", "", "12"], lambda c: names.entity(c)["kind"]) == ["organization", "department", "person", "person_masked", "unknown", "unknown"]
    # a letter that names end with makes no department of a name
    assert apply(spark, ["표사과", "기계과", "표공과", "49회 건축과", "컴퓨터 과"], lambda c: names.entity(c)["kind"]) == ["person", "department", "person", "organization", "department"]
    df = spark.createDataFrame([("김*수", "김*숙"), ("김*수", "이*수"), ("김*수", "김*수")], "a string, b string")
    assert [r[0] for r in df.select(names.masked_distance(F.col("a"), F.col("b"))).collect()] == [ord("숙") - ord("수"), None, 0]


def test_header():
    grid = [["장학금 지급 명단", None, None, None], ["연번", "학생", None, "금액(원)"], [None, None, "학과", None], ["1", "김철수", "경영", "100"]]
    names_, start = clean.header(grid)
    assert names_ == ["연번", "학생", "학과", "금액_원"] and start == 3
    assert clean.header([["a", "a", "1b"]]) == (["a", "a_2", "col_1b"], 1) and clean.header([]) == ([], 0)


def test_row_cleaning(spark):
    rows = [(0, "1", "김철수", "1,000"), (1, "", None, " "), (2, "합계", "", "1,000"), (3, "이 표는 내부 검토를 위하여 만든 자료입니다", None, None), (4, "3명 × 100", "", ""), (5, "100", "100", "100"), (6, "2", "이영희", "500")]
    df = spark.createDataFrame(rows, f"{POSITION} long, a string, b string, c string")
    assert [r[POSITION] for r in clean.drop_non_data(df).orderBy(POSITION).collect()] == [0, 6]
    tail = spark.createDataFrame([(i, s) for i, s in enumerate("1233")], f"{POSITION} long, seq string")
    assert clean.drop_repeated_tail(tail, "seq").count() == 3
    same = spark.createDataFrame([(i, "9") for i in range(4)], f"{POSITION} long, seq string")
    assert clean.drop_repeated_tail(same, "seq").count() == 1
    roster = spark.createDataFrame([("1반 2번 홍길동 3반 4번 김*수", "990101 980202"), ("없음", None)], "r string, b string")
    assert [(r["class"], r["seat"], r["name"], r["birth"]) for r in clean.expand_roster(roster, "r", "b").collect()] == [(1, 2, "홍길동", "990101"), (3, 4, "김*수", "980202")]


def test_identity_groups(spark):
    rows = [(0, "김", "1", None, None), (1, "김", "1", "a", None), (2, "김", None, "a", "k"), (3, "김", None, None, "k"), (4, "김", None, None, "z"), (5, "김", None, None, "z"), (6, "김", None, None, None), (7, "이", "1", None, None)]
    df = spark.createDataFrame(rows, f"{POSITION} long, n string, phone string, email string, cand string")
    got = {r[POSITION]: r["identity"] for r in identity.identity_groups(df, F.col("n"), ["phone", "email"], F.col("cand")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7}


def test_linked_groups_of_a_path(spark):
    members = spark.createDataFrame([(i, k) for i in range(40) for k in (f"k{i}", f"k{i + 1}")], "row long, key string")
    assert {r["group"] for r in linked_groups(members).collect()} == {0}


def test_meanings(spark):
    rows = [(i, str(i + 1), "김철수", f"{i + 1},000", f"2025-03-{i + 1:02d}", "경영학과", f"010-1234-{i:04d}") for i in range(9)]
    df = spark.createDataFrame(rows, f"{POSITION} long, `연번` string, `성명` string, `지급_금액` string, `지급일자` string, `학과` string, `연락처` string")
    found = schema.infer(df)
    assert {c: m.role for c, m in found.items()} == {"연번": "sequence", "성명": "person", "지급_금액": "amount", "지급일자": "date", "학과": "department", "연락처": "phone"}
    assert found["지급_금액"].data_type == "money" and schema.from_json(schema.to_json(found)) == found
    two = {"출연금액": ColumnMeaning("amount", "amount", "money"), "집행금액": ColumnMeaning("amount", "amount", "money")}
    assert schema.amount_column(two, "집행금액 합계")[0] == "집행금액" and schema.amount_column(two, "합계")[0] is None
    assert len(schema.fingerprint(found)) == 24


def test_chunks():
    text = "첫 문단입니다. " * 60 + "\n\n" + "둘째 문단입니다. " * 60
    out = retrieval.chunks(text)
    assert all(20 <= len(c) <= 500 for c in out) and len(out) >= 3
    assert retrieval.chunks("short") == [] and retrieval.chunks("") == [] and all(len(c) <= 500 for c in retrieval.chunks("x" * 1700))


def test_retrieval(spark):
    assert apply(spark, ["장학금은 어떻게 신청 the Fund"], retrieval.terms) == [["장학금", "신청", "the", "fund"]]
    assert apply(spark, ["a: 1 / b: x: y / a: 2"], retrieval.table_fields) == [{"a": "1", "b": "x: y"}]
    hits = spark.createDataFrame([(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.89, [1.0, 0.01]), (1, 3, 0.8, [0.0, 1.0])], "q int, chunk_id int, score double, vector array<double>")
    assert [r["chunk_id"] for r in retrieval.mmr(hits, "q", k=2).orderBy("mmr_rank").collect()] == [1, 3]
    pages = spark.createDataFrame([("s", 1, "a"), ("s", 2, None), ("s", 3, "b")], "source string, page int, section_id string")
    assert [r["section_id"] for r in retrieval.continue_sections(pages).orderBy("page").collect()] == ["a", "a", "b"]
    titles = spark.createDataFrame([(1, "신청 방법"), (2, "방법")], "id int, title string")
    assert [r["id"] for r in retrieval.title_documents(titles, "장학금 신청 방법 알려줘").collect()] == [1]


def test_grids(spark):
    page = "<table><tr><th rowspan=2>A<th colspan=2>B</tr><tr><td>x<td>y</tr></table><table><tr><td>1 &amp; 2</table>"
    assert grids.html_grids(page) == [[["A", "B", "B"], ["A", "x", "y"]], [["1 & 2"]]]
    assert grids.expand_ranges([["a", None], [None, None]], [(0, 0, 1, 1)]) == [["a", "a"], ["a", "a"]]
    rows = grids.page_tables(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert len(rows) == 3 and rows[0]["cells"] == ["A", "B", "B"]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("Contents/section0.xml", '<s xmlns:h="u"><h:p><h:t>하나</h:t><h:t>둘</h:t></h:p><h:p/></s>')
    assert grids.hwpx_text(packed.getvalue()) == "하나둘"


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/tables")
    assert c.load() == {}
    df = spark.createDataFrame([(0, "경영 (12명)")], f"{POSITION} long, `학과` string")
    c.save("t_a", df, "/x/a.xlsx", {"학과": ColumnMeaning("category", "department")}, label="A")
    c.save("t_b", df, "b.xlsx", {})
    tables = c.load()
    assert [t.source for t in tables.values()] == ["a.xlsx", "b.xlsx"] and tables["df0"].frame.collect()[0]["학과"] == "경영"
    assert list(c.scoped({"b.xlsx"})) == ["df1"]
    assert c.drop_source("a.xlsx") == ["t_a"] and [t.source for t in c.load().values()] == ["b.xlsx"]
    assert c.drop("t") == ["t_b"] and c.load() == {}


def test_watch_takes_each_content_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"one")
    (folder / "b.txt").write_bytes(b"two")
    manifest = spark.createDataFrame([("b.txt", "b8a9f715dbb64fd5c56e7783c6820a61", "SUCCESS", "2.4")], "source string, file_hash string, status string, schema_version string")
    q = watch(spark, str(folder), str(tmp_path / "cp"), lambda: manifest, lambda df, n: seen.extend(r["source"] for r in df.collect()))
    q.awaitTermination(60)
    assert seen == ["a.txt"]


def test_entry_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['ledgerloom.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


@pytest.mark.parametrize("name", ["group_sum_top1", "person_totals_components", "rerank"])
def test_registered_queries_run(spark, name):
    from ledgerloom import registry

    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("block", [4096, 40])
def test_searches_over_the_whole_query_set(spark, monkeypatch, block):
    import numpy as np

    from ledgerloom import registry

    monkeypatch.setattr(retrieval, "QUERIES", block)
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in table], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, labels, wanted, best = [r["vec_id"] for r in table], [r["label"] for r in table], [], {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            order = sorted((-s, c, label) for s, c, label in zip(np.round(x @ x[i], 6).tolist(), ids, labels, strict=True))
            wanted += [(ids[i], c, -s, n + 1) for n, (s, c, _) in enumerate(order[:30])]
            for s, c, label in order:
                best.setdefault((ids[i], label), (c, -s))
    run = lambda name: registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, run("vector_topk").collect())) == sorted(wanted) and len({w[0] for w in wanted}) > 5
    assert {(r["query"], r["label"]): (r["chunk_id"], r["score"]) for r in run("per_source_best").collect()} == best
    assert {r["query"] for r in run("mmr").collect()} == {r["query"] for r in run("relative_cut").collect()} == {w[0] for w in wanted}
    assert {r["chunk_id"] for r in run("merge_queries").collect()} == {w[1] for w in wanted}


def test_lexical_overlap_of_all_items(spark):
    from ledgerloom import registry

    folder = "/root/testdata/sf0.001"
    terms = lambda name, key: {r[0]: set(r[1]) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, retrieval.terms(F.col("text"))).collect() if r[1]}
    items, docs = terms("benchmark", "item_id"), terms("documents", "doc_id")
    want = {(i, d, round(len(q & t) / len(q), 6)) for i, q in items.items() for d, t in docs.items() if len(q & t) / len(q) >= 0.4}
    found = [tuple(r) for r in registry.QUERIES["lexical_overlap"](spark, folder).collect()]
    assert set(found) == want and len(found) == len(want) and max(i for i, _, _ in found) > 4


def test_rerank_equals_plain_rules(spark):
    import random

    rng, rows, want = random.Random(3), [], []
    words = [f"w{i}" for i in range(12)]
    share = lambda q, t: len(set(q) & set(t)) / len(q) if q else 0.0
    for query in range(30):
        queries = [rng.sample(words, rng.randint(1, 5)) for _ in range(rng.randint(1, 4))]
        intent, found = rng.random() < 0.3, []
        for chunk in range(rng.randint(1, 25)):
            found.append((query, chunk, round(rng.random(), 3), queries[0], queries[1:], rng.sample(words, rng.randint(0, 6)), rng.sample(words, rng.choice([0, 0, 1, 3])), rng.random(), rng.random(), intent))
        rows += found
        low, high = min(f[2] for f in found), max(f[2] for f in found)
        df = {t: max(1, sum(t in f[5] for f in found)) for t in queries[0]}
        ranked = []
        for f in found:
            title, lexical = max(share(q, f[6]) for q in queries), max(share(q, f[5]) for q in queries)
            rare = sum(1 / df[t] for t in queries[0] if t in f[5]) / sum(1 / n for n in df.values())
            s = 0.45 * ((f[2] - low) / (high - low) if high > low else 1) + 0.15 * lexical + 0.2 * rare + 0.1 * title + 0.05 * f[7] + 0.05 * f[8] + (0.2 if intent and f[6] else 0)
            ranked.append((s, f, title, lexical))
        ranked.sort(key=lambda r: (-r[0], r[1][1]))
        strong = any(r[2] >= 0.5 for r in ranked)
        picked = [r[1] for r in ranked if r[0] >= ranked[0][0] - 0.12 and (not strong or r[2] > 0 or r[3] >= 0.25)][:8]
        kept = []
        for q in queries[1:]:
            rest = [r[1] for r in ranked if r[1] not in picked and share(q, r[1][5]) >= 0.5]
            if rest:
                if len(picked) >= 8:
                    last = [f for f in picked if f not in kept][-1:]
                    if not last:
                        continue
                    picked.remove(last[0])
                picked.append(max(rest, key=lambda f, q=q: share(q, f[5])))
                kept.append(picked[-1])
        want += [(query, f[1], n + 1) for n, f in enumerate(picked)]
    frame = spark.createDataFrame(rows, "query int, chunk_id int, score double, query_terms array<string>, more_terms array<array<string>>, text_terms array<string>, title_terms array<string>, support double, mmr double, section_intent boolean")
    assert sorted((r["query"], r["chunk_id"], r["rank"]) for r in retrieval.rerank(frame, "query").collect()) == sorted(want)


def test_rerank_over_real_terms(spark):
    from ledgerloom import registry

    found = registry.QUERIES["rerank"](spark, "/root/testdata/sf0.001").collect()
    assert len({r["query"] for r in found}) > 5 and all(r["query"] % 20 == 0 and r["rank"] <= 8 for r in found)


def test_profiles_hold_few_cells_in_a_task(spark):
    """The first cells by position count wherever they lie, and what is ranked over tasks are a task's first cells only."""
    import pandas as pd

    batches = lambda: (pd.DataFrame({"at": range(a, a - 50, -1), "c0": ["x"] * 50, "c1": [None, ""] * 25}) for a in range(1000, 0, -50))
    kept = pd.concat(schema.first_cells(batches(), 20))
    assert kept["at"].tolist() == list(range(1, 21)) and set(kept["i"]) == {0}
    rows = [(i, str(i) if i < 40 else "x", None if i % 2 else " 2024-01-02 ", "  ") for i in range(400)]
    df = spark.createDataFrame(rows, f"{POSITION} long, a string, b string, c string").orderBy(F.desc(POSITION)).repartition(3)
    found = {r["column"]: r for r in schema.profile(df, sample=50).collect()}
    assert set(found) == {"a", "b"} and (found["a"]["cells"], found["a"]["number"], found["b"]["cells"], found["b"]["date"]) == (50, 0.8, 50, 1.0)
    plan = schema.profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInPandas" in plan


def test_best_rows_look_at_words_of_the_question_only(spark):
    from ledgerloom.operators import evidence

    rows = [(3, "사업: 사업42 / 접수기간: 3월"), (2, "사업: 사업42로 / 접수기간: 4월"), (1, "사업: 사업42 / 예산: 5원"), (4, "사업: 다른 / 마감: 5월"), (5, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    assert [tuple(r) for r in evidence.period(chunks, "사업42 언제").collect()] == [(2, "4월", 0.5)]
    assert evidence.period(chunks, "없는말 이름").collect() == evidence.period(chunks, "").collect() == []
    question, texts = "사업42로 접수하려면 어떻게", chunks.select("text")
    asked = spark.range(1).select(retrieval.terms(F.lit(question)).alias("t")).collect()[0]["t"]
    for r in texts.select(retrieval.terms(F.col("text")).alias("whole"), retrieval.terms(F.col("text"), asked).alias("some")).collect():
        assert r["whole"] is None or set(r["whole"]) & set(asked) == set(r["some"]) & set(asked)
    # a text's fields and words are worked out in one place of the plan
    plan = evidence.period(chunks, question)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_arrays") == 1 and plan.count("[가-힣A-Za-z0-9]{2,}") <= 2
