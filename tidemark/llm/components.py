"""Connected components of an edge table by alternating star contraction, distributed and restartable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import checkpoint

#: Edges that a task contracts at once.
HELD = 1 << 20


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): each node's least neighbour.  The node is rewritten (to itself), so that its join with the edges deals this small
    side anew: Spark splits a hub of a join only if both sides come straight from a shuffle."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").bitwiseXOR(F.lit(0)).alias("a"), "m")


def large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("m", "a").alias("m"))
    return _directed(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def small_star(edges: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the least of them."""
    least = _least(edges)
    joined = edges.join(least, "a")
    return _directed(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that these edges join it to) of every node of theirs but the least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at.reshape(2, -1)
    up = np.arange(len(nodes))
    while (apart := up[a] != up[b]).any():
        x, y = up[a[apart]], up[b[apart]]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (flat := up[up])).any():
            up = flat
    low = up < np.arange(len(nodes))
    return nodes[low], nodes[up[low]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to stars, HELD edges at a time, that join the same nodes."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        a, b = contract(*(np.concatenate([x[k] for x in held]) for k in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
        size += len(batch)
        if size >= HELD:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    """Fewer edges that join the same nodes: those of each task as stars, so that what fits in one task is settled there."""
    return edges.mapInArrow(_contracted, "a long, b long")


def settled(edges: DataFrame) -> bool:
    """Whether every node hangs on its root: the greater node of an edge stands in no other."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    return ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or (n = 1 and least = 0)").first() is None


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, root) for every node that has an edge in edges(a, b); root is the least node reachable.

    Nodes are longs.  Self-loops and repeated edges change nothing; no edges give no rows.  Each star is checkpointed, so a lost
    executor costs at most one, and the driver plans one at a time; each task contracts the edges that it holds first, so few edges need no star.  Raises if `rounds` do not suffice (they grow with the logarithm of the size).
    """
    now = checkpoint(_stars(_directed(edges)))
    for _ in range(rounds):
        if settled(now):
            return now.select("a", F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("a"), F.col("b").alias("root")).distinct())
        # each star reads its edges several times, so the second one's plan would hold the first one's as often
        now = checkpoint(_stars(small_star(checkpoint(large_star(now)))))
    raise RuntimeError("star contraction did not settle")
