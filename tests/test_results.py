from pyspark.sql import functions as F

from ledgerloom.plans.results import ResultStore, entity_groups, number_text, page, payment_breakdown
from ledgerloom.plans.table import POSITION


def test_results(spark):
    rows = spark.createDataFrame([(i, ["a", "b", " "][i % 3], float([5, 3, 5][i % 3])) for i in range(20)], f"{POSITION} long, name string, v double").repartition(3)
    assert [r[POSITION] for r in page(rows, 5, 4).collect()] == [5, 6, 7, 8] and page(rows, 50, 4).collect() == []
    assert [(r["amount"], r["times"]) for r in payment_breakdown(rows, F.col("v")).collect()] == [(5.0, 13), (3.0, 7)]
    assert [(r["name"], r["n_rows"]) for r in entity_groups(rows, ["name"], F.col("v")).collect()] == [("a", 7), ("b", 7), (None, 6)]
    assert [(r["amount"], r["times"]) for r in payment_breakdown(rows.where(f"{POSITION} < 4"), F.col("v")).collect()] == [(5.0, 1), (3.0, 1), (5.0, 1), (5.0, 1)]
    assert [number_text(x) for x in (1234567, 0.5, -0.001, None, 12.344, 12.346)] == ["1,234,567", "0.5", "0", "", "12.34", "12.35"]


def test_store():
    now = [0.0]
    store = ResultStore(most=2, ttl=10, clock=lambda: now[0])
    a, b, c = (store.put(x) for x in "abc")
    assert store.get(a) is None and store.get(b) == "b" and store.get(c) == "c"
    now[0] = 11
    assert store.get(b) is None and store.held == {}
