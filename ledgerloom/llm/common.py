"""Helpers the training-data operators share: shared storage, Arrow batches, split rules."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.sources.store import shared_root

#: Rows of one Arrow batch that are decoded to Python objects at a time.
SLICE_ROWS = 256

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    return shared_root(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` or the end of the process removes it."""
    path = f"{shared_dir(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_ledgerloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _clean_up() -> None:
    for spark, path in list(_written):
        try:
            if spark.sparkContext._jsc is None:
                return
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


def split_of(column: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids hash as the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: What a row of a sample counts beside its characters, so that short rows are bounded too.
ROW_COST = 64


def hash_limit(rate: float) -> int:
    """The signed 64-bit number up to which a share ``rate`` of all hashes lie; above the least one at every rate."""
    return min(2**63 - 1, int(min(1.0, rate) * 2**64) - 2**63)


def sample_keys(rows: DataFrame, chars: int) -> tuple[list[tuple], dict]:
    """``(label, hash)`` of a sample of ``rows(label, hash, size)``, and the number of all rows of each label.

    Rows are taken in the order of their hashes until a label's characters, with ``ROW_COST`` for each row, reach ``chars``;
    rows that share a hash count as one. Texts of over a quarter of ``chars`` stand back, but a label that
    has any row gets one, at every size of the table.
    """
    short = F.col("size") <= chars // 4
    cost = F.col("size").cast("double") + ROW_COST
    totals = rows.groupBy("label").agg(
        F.sum(F.when(short, cost)).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.when(short, F.col("hash"))).alias("least"), F.min("hash").alias("any")
    ).collect()
    if not totals:
        return [], {}
    near = F.lit(False)
    for r in totals:
        reach = F.col("hash") == r["any"] if r["least"] is None else short & (F.col("hash") <= max(r["least"], hash_limit(2 * chars / r["n"])))
        near = near | (F.col("label").eqNullSafe(F.lit(r["label"])) & reach)
    found = rows.where(near).groupBy("label", "hash").agg(F.max("size").alias("size")).collect()
    left: dict = {}
    keys = []
    for r in sorted(found, key=lambda r: r["hash"]):
        spent = left.get(r["label"], 0)
        if not spent or 0 < spent + r["size"] + ROW_COST <= chars:
            left[r["label"]] = spent + r["size"] + ROW_COST
            keys.append((r["label"], r["hash"]))
        else:
            left[r["label"]] = chars + 1
    missing = {r["label"] for r in totals} - {label for label, _ in keys}
    if missing:
        raise RuntimeError(f"no sample of labels {sorted(map(str, missing))}")
    return keys, {r["label"]: r["rows"] for r in totals}


def sampled(rows: DataFrame, keys: list[tuple], *columns: str) -> list:
    """``columns`` of one row for each of ``keys``, which ``sample_keys`` has bounded."""
    if not keys:
        return []
    chosen = rows.sparkSession.createDataFrame(keys, rows.select("label", "hash").schema)
    return rows.join(F.broadcast(chosen), ["label", "hash"]).dropDuplicates(["label", "hash"]).select(*columns).collect()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocks_of(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of a string column of at most ``size`` bytes together; one longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = n = 0
    for i, length in enumerate(sizes):
        if i > start and n + length > size:
            yield column.slice(start, i - start)
            start, n = i, 0
        n += length
    if start < len(sizes):
        yield column.slice(start)


def map_rows(df: DataFrame, id_col: str, text_col: str, fn: Callable, ddl: str) -> DataFrame:
    """``fn`` over Arrow batches of (id, text); it yields the id column and the columns of ``ddl``.

    The id may be of any type. A struct of a whole row works too and saves joining results to their rows.
    """
    kept = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return kept.mapInArrow(fn, StructType([kept.schema[0], *StructType.fromDDL(ddl).fields]))


def whole_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row as one struct ``__row``, beside its text."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(text_col))


_kept: dict[str, object] = {}


def kept(key: str, build: Callable):
    """What a Python worker keeps from task to task under ``key``: one thing at a time, so stages don't add up."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = build()
        give_back()
    return _kept[key]


def give_back() -> None:
    """Return freed memory to the system, where its C library can: a worker's allocators hold on to what earlier stages used."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    """The same for what is free already, which takes no time to speak of."""
    release_free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release_free is not None:
        release_free(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
