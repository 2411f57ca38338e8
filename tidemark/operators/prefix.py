"""Running totals over all rows of a table, in order of a key, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import checkpoint


def totals_before(sizes: DataFrame, key: str, count: str, name: str) -> DataFrame:
    """(key, name): the sum of `count` over all rows of a smaller key; keys must be distinct, a null one is the smallest.

    Rows are dealt by ranges of the key and added up within their range; then each range is told the sum of those before it, from
    one number a range.  The ranges are drawn from a sample, so what they hold is written before its sums are taken.
    """
    rows = sizes.select(key, F.col(count).cast("long").alias("_c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, TaskContext.get().partitionId()
        for rows in batches:
            ends = total + np.cumsum(rows.column(1).to_numpy())
            before = np.concatenate([[total], ends[:-1]]).astype(np.int64)[: len(rows)]
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(before), pa.array(np.full(len(rows), part))], names=[key, "_c", "_before", "_part"])

    kind = sizes.schema[key].dataType.simpleString()
    ranged = rows.repartitionByRange(key).sortWithinPartitions(key).mapInArrow(run, f"`{key}` {kind}, _c long, _before long, _part long")
    ranged = checkpoint(ranged)
    ends = ranged.groupBy("_part").agg(F.sum("_c").alias("n")).agg(F.array_sort(F.collect_list(F.struct("_part", "n"))).alias("x"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<_part:bigint,n:bigint>>").alias("out"))
    scan = F.aggregate("x", zero, lambda a, p: F.struct((a["n"] + p["n"]).alias("n"), F.concat(a["out"], F.array(F.struct(p["_part"].alias("_part"), a["n"].alias("n")))).alias("out")))
    bases = ends.select(F.explode(scan["out"]).alias("p")).select("p._part", F.col("p.n").alias("_base"))
    return ranged.join(bases, "_part").select(key, (F.col("_base") + F.col("_before")).alias(name))
