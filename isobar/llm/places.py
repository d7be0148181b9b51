"""Exact places of rows in an order, without one task that sorts them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.llm.common import extended, written


def numbered(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with `idx` (0, 1, 2... within each group, in the given order) and `total` (rows of the group), written.

    rows must be a written table, so that it reads the same twice, without columns idx and total; group must not be null. Range partitions are cut by group, order and the row's
    own number, so that a group with a third of all rows, or many equal rows, is spread over many tasks. Each task numbers
    the rows of its part; the counts of (group, part) give the places where parts begin. Equal rows come in any order.
    """
    keys = [F.col(group), *order, F.col("_row")]
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    names, at = spread.columns, spread.columns.index(group)

    def number(batches):
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.column(at).to_numpy(zero_copy_only=False)
            first = np.r_[True, ends[1:] != ends[:-1]]
            run = np.maximum.accumulate(np.where(first, np.arange(len(ends)), 0))
            local = np.arange(len(ends)) - run
            if ends[0] == last:
                local[run == 0] += seen
            last, seen = ends[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(local, pa.int64())],
                                             names=[*names, "_part", "_local"])

    local = written(spread.mapInArrow(number, extended(spread.schema, "_part int, _local long")))
    counts = local.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(W.partitionBy(group)).alias("total"))
    return written(local.join(starts, [group, "_part"]).select(*names, (F.col("_start") + F.col("_local")).alias("idx"), "total"))
