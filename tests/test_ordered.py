"""Running values over ranges of sorted rows against plain Python."""

from __future__ import annotations

import random

import pytest

from ledgerloom.operators.ordered import running

SCHEMA = "key string, sub long, at long, step long, mark string, other double"


def rows_of(n=900, seed=2):
    """Half of all rows have one key; null keys, null places, null steps."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key, sub = ("hot", 1) if rng.random() < 0.5 else (rng.choice(["a", "b", "", None]), rng.choice([1, 2, None]))
        out.append((key, sub, None if i < 5 else i * 7 % 1009, rng.choice([None, 0, 1, 5]), rng.choice([None, None, None, f"m{i}"]), 0.5))
    return out


def by_hand(rows):
    totals, last, out = {}, {}, []
    nulls_first = lambda x: (x is not None, x if x is not None else 0)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", nulls_first(r[1]), nulls_first(r[2]))):
        k = r[:2]
        totals[k] = totals.get(k, 0) + (r[3] or 0)
        last[k] = r[4] if r[4] is not None else last.get(k)
        out.append((*r, totals[k], last[k]))
    return out


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_running_equals_a_plain_scan(spark, partitions):
    rows = [r for i, r in enumerate(rows_of()) if i >= 5 or i == 0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        found = running(df, ["key", "sub"], ["at"], sums={"total": "step"}, lasts={"open": "mark"})
        assert found.columns == [*df.columns, "total", "open"]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(by_hand(rows), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_rows_spread_over_partitions(spark):
    """Rows equal in key and order count on, whichever partition they are in."""
    df = spark.createDataFrame([("k", 1, 3, 1, None, 0.0)] * 500, SCHEMA).repartition(4)
    assert sorted(r["total"] for r in running(df, ["key"], ["at"], sums={"total": "step"}).collect()) == list(range(1, 501))


def test_running_of_nothing(spark):
    assert running(spark.createDataFrame([], SCHEMA), ["key"], ["at"], sums={"total": "step"}, lasts={"open": "mark"}).collect() == []


def test_sections_of_one_long_document(spark):
    """One source of many pages is read in many tasks, with the sections of a plain walk."""
    from pyspark.sql import functions as F

    from ledgerloom.operators import retrieval, sections

    n = 3000
    body = "이 장에서는 지원 대상과 기준을 정한다. 자세한 내용은 아래와 같다."
    rows = [("long.pdf", p, (f"{p // 50 + 1}. 제목 {p}\n" if p % 50 == 3 else "") + f"{body} {p}쪽") for p in range(n)] + [("b.pdf", 1, f"1. 첫째\n{body}"), (None, 1, f"1. 없음\n{body}")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sections.page_sections(spark.createDataFrame(rows, "source string, page long, text string").repartition(6)).collect()
        pages = spark.createDataFrame([("long.pdf", p, f"s{p}" if p % 70 == 5 else None) for p in range(n)], "source string, page int, section_id string")
        carried = running(pages, ["source"], ["page"], lasts={"open": "section_id"})
        assert carried.withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 1
        assert {r["page"]: r["section_id"] for r in retrieval.continue_sections(pages).collect()} == {p: f"s{(p - 5) // 70 * 70 + 5}" if p >= 5 else None for p in range(n)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    of = {r["page"]: r for r in found if r["source"] == "long.pdf"}
    assert sorted(of) == list(range(3, n)) and len(found) == n - 3 + 2
    for p, r in of.items():
        start = (p - 3) // 50 * 50 + 3
        last = min(start + 49, n - 1)
        assert (r["section_id"], r["child_index"], r["child_count"]) == (f"p{start}:s0", p - start, last - start + 1)
