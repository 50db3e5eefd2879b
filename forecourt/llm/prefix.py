"""Global running sums over an ordered table, from per-partition totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import estimated_bytes, files_for, partitions, small_batches, written

#: Ranges up to this number are written into a file each.
FILES = 64
#: Estimated bytes for which a range of its own is worth a task; tables of many take all of the session's partitions.
RANGE_BYTES = 1 << 20


def ranges_for(df: DataFrame) -> int:
    """Ranges to deal df into: the session's partitions, or fewer for a small table."""
    return min(partitions(df.sparkSession), -(-max(estimated_bytes(df), 1) // RANGE_BYTES))


def _local_sums(group_at: int | None, size_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, seen = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(size_at).to_numpy()
            if group_at is None:
                firsts = np.array([0])
                last, known = 0, last is not None
            else:
                group = batch.column(group_at).to_numpy()
                firsts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
                known, last = last is not None and group[0] == last, group[-1]
            total = np.cumsum(size)
            begin = np.repeat(firsts, np.diff(np.append(firsts, len(size))))
            start = total - size - (total - size)[begin]
            rank = np.arange(len(size)) - begin
            if known:  # the group goes on from the batch before
                head = begin == 0
                start[head] += before
                rank[head] += seen
            before, seen = int(start[-1] + size[-1]), int(rank[-1] + 1)
            own = [pa.array(start.astype(np.int64)), pa.array(rank.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "_start", "_rank"])

    return run


def running_sums(df: DataFrame, order: list, size: str, group: str | None = None, measure: Column | None = None) -> DataFrame:
    """df with _start and _rank: the sum of `size` and the number of rows before each row, within its group.

    Rows are dealt into ranges of (group, *order) and sorted there; the sums go on from
    range to range by the ranges' totals, of which there is one row per range and
    group. `group` and `size` are longs without nulls. No task gets more than one range,
    whatever the groups' sizes. If df lacks `size`, `measure` gives it, and only for the sorted
    rows: finding the ranges computes all columns of df once more. The rows are written once to the shared folder, so that
    every later step sees the same ranges.
    """
    spark = df.sparkSession
    small_batches(spark)
    keys = [F.col(group), *order] if group else order
    ranged = df.repartitionByRange(ranges_for(df), *keys).sortWithinPartitions(*keys)
    ranged = ranged if measure is None else ranged.withColumn(size, measure)
    ranged = ranged.withColumn("_part", F.spark_partition_id().cast("long"))
    schema = StructType(list(ranged.schema.fields))
    for name in ("_start", "_rank"):
        schema = schema.add(name, LongType())
    sums = written(ranged.mapInArrow(_local_sums(ranged.columns.index(group) if group else None, ranged.columns.index(size)), schema), "ranges", files=max(files_for(df), FILES, partitions(spark) // 4))  # rows may be wide: a task writes few ranges
    by = [*([F.col(group).alias("_of")] if group else [F.lit(0).cast("long").alias("_of")]), F.col("_part").alias("_at")]
    totals = sums.groupBy(*by).agg(F.sum(size).alias("_size"), F.count("*").alias("_rows"))
    from pyspark.sql import Window

    # One row per range and group: a range holds part of one group, or whole groups between two cut ones.
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(totals.select("_of", "_at", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_size_0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_0")).where("_rows_0 > 0"), "offsets", files=1)
    # Only groups that go on from a range before have a row here: at most one for each range.
    on = (F.col("_at") == F.col("_part")) & (F.col("_of") == (F.col(group) if group else F.lit(0).cast("long")))
    met = sums.join(F.broadcast(offsets), on, "left")
    more = {"_start": F.col("_start") + F.coalesce("_size_0", F.lit(0)), "_rank": F.col("_rank") + F.coalesce("_rows_0", F.lit(0))}
    return met.withColumns(more).drop("_part", "_of", "_at", "_size_0", "_rows_0")
