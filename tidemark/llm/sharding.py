"""Weighted rendezvous hashing of record keys over shards.

Every (key, shard) pair gets a uniform draw u from a stable hash; the row goes to the shard with the largest
`-weight / ln(u)`.  A key and the shard list decide alone, so a new shard takes rows only into itself and a
removed one gives up only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._text import partitions


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that a key belongs to.  A null key counts as one further key value."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative and one of them positive")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit(""))
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
            draws.append(F.struct((-F.lit(float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("minus")))
    return (-F.array_max(F.array(*draws))["minus"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Adds shard, and grown_shard for the weights of a larger layout (null without one).  No shuffle."""
    out = df.withColumn("shard", shard_of(F.col(f"`{key}`"), weights))
    return out.withColumn("grown_shard", shard_of(F.col(f"`{key}`"), grown) if grown else F.lit(None).cast("int"))


def add_slots(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Adds slot, a gapless number from 0 within each shard.

    Rows are numbered within (shard, bucket) groups, and a small table of group sizes gives each group its
    first number, so no shard is ever gathered in one task.  A bucket comes from the key and `order`, so the rows of a repeated key spread
    as far as they differ; equal rows are interchangeable.
    """
    n = 4 * partitions(df.sparkSession)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), *order), F.lit(n)).cast("int"))
    sizes = df.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_bucket").orderBy(key, *order)
    numbered = df.withColumn("_place", F.row_number().over(within))
    return numbered.join(first, ["shard", "_bucket"]).withColumn("slot", F.col("_first") + F.col("_place") - 1).drop("_bucket", "_first", "_place")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by its doc_id over equal shards.

    Null text: size 1 and the CRC of nothing, 0.  A very long text is read once, for its size and CRC.  A null doc_id is a key of its own.  Repeated rows each get a slot.
    An empty table gives no rows; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign_shards(rows, "doc_id", [1.0] * shards, [1.0] * (shards + 1))
    return add_slots(rows, "doc_id", ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
