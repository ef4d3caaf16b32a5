"""Nearest masked names by blocks against all pairs, and searches by the index against scans."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.operators import nameblocks, scope
from ledgerloom.operators.nameblocks import NameIndex
from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef


def far(a, b):
    if len(a) != len(b) or a[:1] != b[:1] or any((x == "가") != (y == "가") or x != y for x, y in zip(shape(a), shape(b), strict=True)):
        return None
    gaps = [abs(ord(x) - ord(y)) for x, y in zip(a, b, strict=True)]
    return sum(gaps) if sum(g > 0 for g in gaps) <= 1 else None


def shape(name):
    return ["가" if "가" <= c <= "힣" else c for c in name]


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(3)
    letter = lambda: rng.choice([*"*a", *(chr(rng.randint(0xAC00, 0xAC00 + 700)) for _ in range(4))])
    made = ["".join([rng.choice("김이"), *(letter() for _ in range(rng.randint(0, 3)))]) for _ in range(500)] + ["김*수", "김*수", "", "*", "김"]
    asked = [*made[:60], "김*순", "박*수", "김", ""]
    df = lambda values, c: spark.createDataFrame([(v,) for v in [*values, None]], f"{c} string").repartition(3)
    for most in (180, 3):
        expected = []
        for q in set(asked):
            near = [(d, n) for n in set(made) if (d := far(q, n)) is not None and d <= most]
            expected += [(q, n, d) for d, n in near if d == min(near)[0]]
        assert sorted(tuple(r) for r in nameblocks.nearest(df(asked, "query"), df(made, "name"), most).collect()) == sorted(expected)
    # the distance is that of the expression on single pairs
    pairs = spark.createDataFrame([(a, b) for a in made[:40] for b in made[40:80] if a and b], "a string, b string")
    for r in pairs.select("a", "b", names.masked_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r["d"] == far(r["a"], r["b"])


def test_search_by_index_equals_a_scan(spark, tmp_path):
    rows = []
    for i in range(200):
        name = "김이박"[i % 3] + "민서지하"[i % 4] + "준연우은호"[i % 5]
        hidden = i % 3 == 0
        rows.append((i, None if i == 7 else name[0] + "*" + name[2] if hidden else name, name[0] + "*" + name[2], hidden, 1000.0 * i if i % 9 else None))
    frame = spark.createDataFrame(rows, f"{POSITION} long, `성명_검색키` string, `성명_마스킹패턴` string, `성명_마스킹여부` boolean, `금액` double")
    plain = spark.createDataFrame([(0, "김민준 외 2명"), (1, "다른 이")], f"{POSITION} long, `이름` string")
    money = {"금액": ColumnMeaning("amount", "amount", "money", "KRW")}
    tables = {"df0": TableRef("df0", "a.xlsx", frame, money), "df1": TableRef("df1", "b.xlsx", frame.where(f"{POSITION} > 50"), money), "df2": TableRef("df2", "c.xlsx", plain)}
    index = NameIndex(spark, f"file://{tmp_path}/names")
    scope.index_names(index, tables)
    of = lambda found: None if found.rows is None else sorted(((r["source"], r[POSITION], r["_match"], r["_asked"]) for r in found.rows.collect()), key=str)
    for q in ("김민준의 금액", "이*연 금액", "박서은과 김민준", "김＊우", "없는사람", "최고은 얼마"):
        assert of(scope.name_search(tables, q, index)) == of(scope.name_search(tables, q)), q
    # one name reads few rows
    assert index.rows_near(["김민준"]).count() < 60


def test_large_amounts_are_amounts_and_organisations_no_names(spark, tmp_path):
    """Stored numbers of ten million and more are written with an exponent as text; NaN is no amount."""
    rows = [(0, "김민준", 9e6), (1, "김민준", 1e7), (2, "김민준", 1.5e12), (3, "김민준", float("nan")), (4, "김민준", None)]
    money = {"금액": ColumnMeaning("amount", "amount", "money", "KRW")}
    frame = spark.createDataFrame(rows, f"{POSITION} long, `성명_검색키` string, `금액` double")
    tables = {"df0": TableRef("df0", "a.xlsx", frame, money)}
    index = NameIndex(spark, f"file://{tmp_path}/names")
    scope.index_names(index, tables)
    for found in (scope.name_search(tables, "김민준의 금액"), scope.name_search(tables, "김민준의 금액", index)):
        assert sorted(r[POSITION] for r in found.rows.collect()) == [0, 1, 2]


def test_rows_without_a_search_key_hide_no_name(spark):
    rows = [(0, "이*준", "이*준", True), (1, None, "이*준", True), (2, "", "이*준", True), (3, "이민준", "이*준", False)]
    frame = spark.createDataFrame(rows, f"{POSITION} long, `성명_검색키` string, `성명_마스킹패턴` string, `성명_마스킹여부` boolean")
    found = scope.name_search({"df0": TableRef("df0", "a.xlsx", frame.where(f"{POSITION} < 3"))}, "이민준 알려줘")
    assert [(r[POSITION], r["_match"]) for r in found.rows.collect()] == [(0, "masked_candidate_match")]
