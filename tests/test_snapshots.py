"""The snapshot store and the catalog's swap: what readers see while writers are at work."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.table import POSITION
from ledgerloom.sources import files
from ledgerloom.sources.catalog import Catalog
from ledgerloom.sources.snapshots import SnapshotStore


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    schema = spark.createDataFrame([], "source string, id long, text string").schema
    return SnapshotStore(spark, f"file://{tmp_path}/store", schema)


def frame(spark, *values):
    return spark.createDataFrame(list(values), "source string, id long, text string")


def test_versions_stay_as_they_were(spark, store):
    assert store.latest() == 0 and rows(store.read()) == []
    assert store.replace(frame(spark, ("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), (None, 4, "z"))) == 1
    assert store.replace(frame(spark, ("a", 5, "new"))) == 2
    assert store.delete(spark.createDataFrame([("b",), (None,), ("never there",)], "source string")) == 3
    assert rows(store.read(1)) == sorted([("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), (None, 4, "z")], key=str)
    assert rows(store.read(2)) == sorted([("a", 5, "new"), ("b", 3, "y"), (None, 4, "z")], key=str)
    assert rows(store.read()) == [("a", 5, "new")]
    assert rows(store.of_source("a")) == [("a", 5, "new")] and rows(store.of_source("b", 2)) == [("b", 3, "y")]
    assert rows(store.counts()) == [("a", 1)]
    # a deleted source may come back
    store.replace(frame(spark, ("b", 9, "back")))
    assert rows(store.read()) == [("a", 5, "new"), ("b", 9, "back")]


def test_nothing_is_seen_before_it_is_published(spark, store):
    store.replace(frame(spark, ("a", 1, "old")))
    reading = store.read()
    staged = store.stage(frame(spark, ("a", 2, "new")))
    assert rows(store.read()) == [("a", 1, "old")]
    store.publish(staged)
    assert rows(store.read()) == [("a", 2, "new")]
    assert rows(reading) == [("a", 1, "old")]  # planned before, read after


def test_writers_do_not_lose_each_other(spark, store):
    staged = [store.stage(frame(spark, (f"s{i}", i, "t"), ("shared", i, "t"))) for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(store.publish, staged))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    last = staged[versions.index(6)]
    assert {r[0] for r in rows(store.read())} == {f"s{i}" for i in range(6)} | {"shared"}
    assert [r[1] for r in rows(store.of_source("shared"))] == [staged.index(last)]


def test_compaction_and_vacuum(spark, store):
    for i in range(4):
        store.replace(frame(spark, ("a", i, "t"), (f"s{i}", i, "t")))
    before = rows(store.read())
    old = store.commits()
    late = store.stage(frame(spark, ("late", 7, "t")))
    compacted = store.stage(store.read())
    store.publish(late)  # another writer while a compaction is under way
    store.publish(compacted, old)
    assert rows(store.read()) == sorted([*before, ("late", 7, "t")], key=str) and len(store.commits()) == 2
    assert sorted(store.vacuum(keep=1)) == sorted(old)
    assert rows(store.read()) == sorted([*before, ("late", 7, "t")], key=str) and store.versions() == [6]
    with pytest.raises(RuntimeError):
        store.publish(store.stage(), old)


def test_a_taken_name_is_not_overwritten(spark, tmp_path):
    path = f"file://{tmp_path}/x/one.json"
    assert files.publish(spark, path, "first") and not files.publish(spark, path, "second")
    assert files.read_text(spark, path) == "first"
    files.swap(spark, path, "third")
    assert files.read_text(spark, path) == "third" and files.names_in(spark, f"file://{tmp_path}/x") == ["one.json"]
    assert files.names_in(spark, f"file://{tmp_path}/nowhere") == []


def test_a_table_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    c = Catalog(spark, f"file://{tmp_path}/tables")
    of = lambda n: spark.createDataFrame([(n,)], f"{POSITION} long")
    c.save("t", of(1), "t.xlsx", {})
    reading = c.load()["df0"].frame
    # a writer that fails leaves the table as it was
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Job aborted|TASK_WRITE_FAILED"):
        c.save("t", of(2).select((F.lit(1) / (F.col(POSITION) - 2)).alias(POSITION)), "t.xlsx", {})
    assert c.load()["df0"].frame.collect() == reading.collect()
    c.save("t", of(3), "t.xlsx", {})
    assert [r[0] for r in reading.collect()] == [1] and [r[0] for r in c.load()["df0"].frame.collect()] == [3]
    c.save("t", of(4), "t.xlsx", {})
    assert [r[0] for r in c.load()["df0"].frame.collect()] == [4] and sum("rows-t-" in n for n in files.names_in(spark, f"file://{tmp_path}/tables")) == 3
    assert c.drop("t") == ["t"] and c.load() == {}


def test_profiles_are_written_once_and_taken_over(spark, tmp_path):
    from ledgerloom.operators import schema
    from ledgerloom.plans.table import ColumnMeaning
    from ledgerloom.sources.profiles import StoredProfiles

    df = spark.createDataFrame([(0, "1", "x")], f"{POSITION} long, `값` string, `부서` string")
    fresh = schema.infer(df)
    one, other = StoredProfiles(spark, f"file://{tmp_path}/p"), StoredProfiles(spark, f"file://{tmp_path}/p")
    made = [{c: ColumnMeaning(f"concept{i}", m.role, m.data_type) for c, m in fresh.items()} for i in range(5)]
    with ThreadPoolExecutor(5) as pool:
        kept = list(pool.map(one.keep, made))
    assert all(k == kept[0] for k in kept) and kept[0] in made and other.of(df) == kept[0]
    right = one.correct(fresh, {"값": ColumnMeaning("amount", "amount", "money", "KRW")})
    assert other.of(df) == right and right["부서"] == fresh["부서"]
    assert other.of(df.select(POSITION, "`값`")) == schema.infer(df.select(POSITION, "`값`"))  # other columns, other profile
