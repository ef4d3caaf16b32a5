"""The exact median by passes over parts, against sorted values."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import execute
from ledgerloom.plans.execute import exact_median


def expected(values):
    held = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    return (held[(len(held) - 1) // 2] + held[len(held) // 2]) / 2 if held else None


def median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    return exact_median(df, F.col("x")).collect()[0]["value"]


CASES = {
    "none": [], "nulls": [None, None], "one": [3.5], "two": [1.0, 2.0], "ties": [2.0] * 7 + [3.0] * 7, "signs": [-5.0, -1e-300, 0.0, -0.0, 1e-300, 7.0],
    "wide": [10.0**k for k in range(-300, 300, 7)] + [-(10.0**k) for k in range(-300, 300, 11)], "ends": [float("-inf"), float("inf"), 1.0, None], "close": [1.0 + k * 2**-52 for k in range(60)],
}


@pytest.mark.parametrize("few", [execute.FEW, 0, 3])
@pytest.mark.parametrize("name", CASES)
def test_median_of_cases(spark, monkeypatch, name, few):
    monkeypatch.setattr(execute, "FEW", few)
    assert median(spark, CASES[name]) == expected(CASES[name])


def test_median_of_many(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.choice([rng.lognormvariate(8, 3), -rng.random(), float(rng.randint(0, 9)), None]) for _ in range(4001)]
    for few, parts in ((execute.FEW, execute.PARTS), (5, 4), (0, 2)):
        monkeypatch.setattr(execute, "FEW", few)
        monkeypatch.setattr(execute, "PARTS", parts)
        assert median(spark, values) == expected(values)
    assert math.isnan(median(spark, [float("nan")] * 3 + [1.0]))


def test_passes_filter_the_scan_and_have_no_window(spark, tmp_path):
    spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x").write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    plan = df.where((F.col("x") >= 2.0) & (F.col("x") <= 5.0)).groupBy(F.width_bucket("x", F.lit(2.0), F.lit(5.0), F.lit(8))).count()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "GreaterThanOrEqual(x,2.0)" in plan and "LessThanOrEqual(x,5.0)" in plan
    assert exact_median(df, F.col("x")).collect()[0]["value"] == 499.5


def test_stored_numbers_are_money_as_they_are(spark):
    """Large amounts are written with an exponent as text; they are numbers all the same, in the unit of their column."""
    from ledgerloom.plans.model import QueryPlan
    from ledgerloom.plans.table import POSITION, ColumnMeaning, TableRef

    rows = spark.createDataFrame([(0, 12_345_678.5, 3), (1, 1e9, 5), (2, None, None)], f"{POSITION} long, a double, b int")
    meanings = {"a": ColumnMeaning("amount", "amount", "money", "KRW"), "b": ColumnMeaning("amount", "amount", "money", "KRW_10000")}
    of = lambda c: execute.execute(QueryPlan(dataframe="t", operation="sum", target=c), TableRef("t", "t", rows, meanings)).result.collect()[0]["value"]
    assert (of("a"), of("b")) == (1_012_345_678.5, 80_000.0)
