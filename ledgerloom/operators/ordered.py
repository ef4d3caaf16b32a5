"""Running values along an order within keys, when one key may hold most rows.

A window over a key reads all its rows in one task. Here rows are dealt out by ranges of key and order, so a large key spreads over many tasks;
each computes its own running values, and what a key gathered in the partitions before is added from a small table: a key reaches into a
further partition only as that partition's first key, so the table has at most two rows for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ledgerloom.sources.store import written


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Whether each row but the first has another key than the row before; nulls equal each other."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differ = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


def _local(keys: list[str], sums: dict[str, str], lasts: dict[str, str], schema: StructType):
    """Running values inside one sorted partition, batch by batch."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held_key, totals, carried, rows, first_run = None, dict.fromkeys(sums, 0), dict.fromkeys(lasts), 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            begins = np.concatenate(([False], changes(columns)))
            key = tuple(c[0].as_py() for c in columns)
            if held_key is not None and key != held_key:
                begins[0] = True
            starts = np.flatnonzero(begins)
            run_of = np.cumsum(begins)  # 0 goes on with the run of the batch before
            out = {}
            for name, column in sums.items():
                steps = pc.fill_null(batch.column(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(steps)
                before = np.concatenate(([-totals[name]], (upto - steps)[starts]))
                out[name] = pa.array(upto - before[run_of])
                totals[name] = int(upto[-1] - before[run_of[-1]])
            for name, column in lasts.items():
                values = batch.column(column)
                known = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                floor = np.concatenate(([0], starts))[run_of]
                at = np.where(known >= floor, known, -1)
                filled = values.take(pa.array(at, mask=at < 0))
                if carried[name] is not None:
                    filled = pc.if_else(pa.array((at < 0) & (run_of == 0)), pa.scalar(carried[name], values.type), filled)
                out[name] = filled
                carried[name] = filled[n - 1].as_py()
            is_first = (run_of == 0) & first_run
            first_run = first_run and not len(starts)
            held_key = tuple(c[n - 1].as_py() for c in columns)
            extra = {"__part": pa.array(np.full(n, part, np.int32)), "__row": pa.array(np.arange(rows, rows + n)), "__first": pa.array(is_first)}
            rows += n
            given = {**{c: batch.column(c) for c in batch.schema.names}, **out, **extra}
            yield pa.RecordBatch.from_arrays([given[f.name] for f in schema.fields], names=schema.names)

    return run


def running(df: DataFrame, keys: list[str], order: list[str], *, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running values within ``keys`` along ``order`` (ascending, nulls first), each row's own value included.

    ``sums`` maps new columns to the whole-number columns that they add up (null adds nothing), ``lasts`` to columns whose last value that isn't null
    they hold. Rows that are equal in keys and order come in no stated order. Null keys are a key. The sorted rows are
    written to the shared folder once; an empty table gives an empty one.
    """
    sums, lasts = sums or {}, lasts or {}
    kinds = {f.name: f for f in df.schema.fields}
    fields = [*df.schema.fields, *(StructField(c, LongType()) for c in sums), *(StructField(c, kinds[v].dataType) for c, v in lasts.items())]
    schema = StructType([*fields, StructField("__part", IntegerType()), StructField("__row", LongType()), StructField("__first", BooleanType())])
    # equal rows may be more than a partition should hold, so they are told apart for the ranges
    salted = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(*(F.col(c) for c in (*keys, *order, "__salt"))).sortWithinPartitions(*keys, *order).drop("__salt")
    local = written(dealt.mapInArrow(_local(keys, sums, lasts, schema), schema), "running")
    begun = local.where("__first").groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n")).where("__part > 0").select(*keys).distinct()
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    met = local.alias("l").join(F.broadcast(begun).alias("r"), same, "left_semi")
    totals = [F.sum(F.col(v)).alias(c) for c, v in sums.items()] + [F.max_by(c, "__row").alias(c) for c in lasts]
    by_part = met.groupBy(*keys, "__part").agg(*totals)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__carry_{c}") for c in sums] + [F.last(c, ignorenulls=True).over(before).alias(f"__carry_{c}") for c in lasts]
    carry = by_part.select(*keys, "__part", *carried)
    joined = local.alias("l").join(F.broadcast(carry).alias("r"), [F.col("l.__part") == F.col("r.__part"), *same], "left")
    plain = [F.col(f"l.{c}") for c in df.columns]
    added = [(F.col(f"l.{c}") + F.coalesce(F.col(f"r.__carry_{c}"), F.lit(0))).alias(c) for c in sums]
    filled = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.__carry_{c}")).alias(c) for c in lasts]
    return joined.select(*plain, *added, *filled)
