"""De-duplication of timed rows.  Five rules that differ in what they compare with; none replaces another.

Every rule works on (clip, t, id, conf) rows, t in integer microseconds; `id` breaks ties.  The order-dependent ones pass over a
clip's rows in order and hold the current survivor alone (see ordered); suppression by priority holds the rows that later ones may
still change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.kernels import settle
from tidemark.operators.ordered import changes, dealt, more, survivors


def in_time(clip: str = "clip", t: str = "t", id: str = "id"):
    return Window.partitionBy(clip).orderBy(t, id)


def segments(df: DataFrame, gap: int | Column, join_equal: bool = False, name: str = "_segment") -> DataFrame:
    """Numbers stretches of a clip between gaps of `gap` or more (more than `gap` if join_equal)."""
    w = in_time()
    step = F.col("t") - F.lag("t").over(w)
    opens = step.isNull() | ((step > gap) if join_equal else (step >= gap))
    return df.withColumn("_opens", opens.cast("int")).withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def _kept(df: DataFrame, step, extra: tuple[str, ...] = ()) -> DataFrame:
    """The survivors under step(current, anchor, row), rows being (t, id, conf, *extra)."""
    return survivors(df, ("clip",), ("t", "id", "conf", *extra), step).select("clip", "id", "t", "conf", *extra)


def nms_anchored(df: DataFrame, window: int | str) -> DataFrame:
    """A cluster is every row less than `window` after its first row; the best confidence stays, the first on ties.

    window may name a column that is the same for all rows of a clip, which then comes along.
    """
    if isinstance(window, str):
        return _kept(df, lambda cur, anchor, x: (x[0] - anchor < x[3], more(x[2], cur[2])), (window,))
    if window <= 0:
        return df.select("clip", "id", "t", "conf")
    return _kept(df, lambda cur, anchor, x: (x[0] - anchor < window, more(x[2], cur[2])))


def dedup_last_kept(df: DataFrame, gap: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row less than `gap` after the last survivor joins it and takes its place if its confidence is strictly higher.  Columns `extra` come along."""
    return _kept(df, lambda cur, anchor, x: (x[0] - cur[0] < gap, more(x[2], cur[2])), extra)


def dedup_moving_best(df: DataFrame, gap: int, more_than: int = 5) -> DataFrame:
    """As dedup_last_kept - distances are measured from the running best - in clips of more than `more_than` rows only."""
    n = df.withColumn("_n", F.count("*").over(Window.partitionBy("clip")))
    few = n.where(F.col("_n") <= more_than).select("clip", "id", "t", "conf")
    return dedup_last_kept(n.where(F.col("_n") > more_than).drop("_n"), gap).unionByName(few)


def dedup_soft(df: DataFrame, low: int, high: int, value: str, near: float) -> DataFrame:
    """A row from low to high after the last survivor (both included) whose `value` differs by less than `near` joins it."""
    def step(cur, anchor, x):
        alike = x[3] is not None and cur[3] is not None and abs(x[3] - cur[3]) < near
        return low <= x[0] - cur[0] <= high and alike, more(x[2], cur[2])

    return _kept(df, step, (value,))


def thin_keep_first(df: DataFrame, gap: int) -> DataFrame:
    """A row stays if it is `gap` or more after the last one that stayed."""
    return _kept(df, lambda cur, anchor, x: (x[0] - cur[0] < gap, False))


def cluster_gap_chain(df: DataFrame, window: int | Column) -> DataFrame:
    """Adds cluster, from 0 in each clip: a row joins the one before it if the gap is at most `window`."""
    return segments(df, window, join_equal=True, name="cluster").withColumn("cluster", F.col("cluster") - 1)


def cluster_best(df: DataFrame, window: int) -> DataFrame:
    """The best-scoring row of each gap chain, the first on ties."""
    w = Window.partitionBy("clip", "cluster").orderBy(F.col("conf").desc(), "t", "id")
    return cluster_gap_chain(df, window).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cluster_rank(df: DataFrame, window: int) -> DataFrame:
    """Adds rank: the row's place by score within its gap chain, from 1."""
    w = Window.partitionBy("clip", "cluster").orderBy(F.col("conf").desc(), "t", "id")
    return cluster_gap_chain(df, window).withColumn("rank", F.row_number().over(w))


def cluster_session_window(df: DataFrame, window: int) -> DataFrame:
    """The gap chains as session windows: clip, first and last t, number of rows.  `ts` must be a timestamp column."""
    s = F.session_window("ts", f"{window} microseconds")
    return df.groupBy("clip", s.alias("s")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n")).drop("s")


#: Distances that a stretch of suppress_priority spans.
STRETCH = 16


def suppress_priority(df: DataFrame, distance: int, stretches: bool = False) -> DataFrame:
    """From the highest confidence down, a row that stays removes all others less than `distance` away; later rows win ties.

    A clip's rows pass in order of time.  Rows whose fate no later row can change are decided and leave; what is held is the
    batch and the rows still open, so a stretch without gaps is never one row, group or array.

    With `stretches`, for clips too long for a task: rows are first dealt by stretches of STRETCH distances, each of which decides what no row beyond its ends can
    change, then the open rows by stretches that begin half a stretch later, and only what is open even then passes clip by clip.
    """
    chosen = df.select("clip", "t", "id", "conf", F.lit(False).alias("_kept"), F.lit(None).cast("long").alias("_part"))
    width = STRETCH * distance

    def step(begin: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, settled = None, 0
            for batch in batches:
                done = batch.column(4)
                if pc.any(done).as_py():
                    yield batch.filter(done)
                    batch = batch.filter(pc.invert(done))
                if not len(batch):
                    continue
                held = batch if held is None else pa.concat_batches([held, batch])
                if len(held) >= 2 * settled:  # so that rows that stay open for long are not gone through with every batch
                    out, held, passed = _decided(held, distance, False, width, begin)
                    settled = len(held)
                    yield from (out, passed)
            if held is not None:
                out, _, passed = _decided(held, distance, True, width, begin)
                yield from (out, passed)

        return run

    rows = chosen
    for begin in (0, width // 2, None) if stretches and distance > 0 else (None,):
        # rows that stay already are dealt anywhere
        part = F.lit(None).cast("long") if begin is None else F.floor((F.col("t") - begin) / width)
        rows = rows.withColumn("_part", F.when(F.col("_kept"), F.xxhash64("id")).otherwise(part))
        rows = dealt(rows, ("clip", "_part"), ("t", "id")).mapInArrow(step(begin), chosen.schema)
    return rows.select("clip", "id", "t", "conf")


def _decided(rows: pa.RecordBatch, distance: int, last: bool, width: int, start: int | None) -> tuple[pa.RecordBatch, pa.RecordBatch, pa.RecordBatch]:
    """(rows that stay, rows still open, open rows of stretches that have ended) of sorted rows; only the last stretch can have open ones of the former kind, and none if `last`.

    Stretches of `width` begin at `start`; where it is None, they are whole clips, beyond whose ends nothing is.
    """
    at = rows.column(1).to_numpy(zero_copy_only=False)
    height = rows.column(3).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(changes(rows, 1) | _moved(rows.column(5)))
    keep, open_, passed = (np.zeros(len(rows), bool) for _ in range(3))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(rows)]):
        ended = last or b < len(rows)
        if start is None:
            keep[a:b], open_[a:b] = settle(at[a:b], height[a:b], distance, ended)
            continue
        first = start + (at[a] - start) // width * width
        edge = (at[a:b] - first < distance) | ((first + width - at[a:b] <= distance) if ended else False)
        keep[a:b], left = settle(at[a:b], height[a:b], distance, ended, edge)
        (passed if ended else open_)[a:b] = left
    kept = rows.filter(pa.array(keep))
    kept = kept.set_column(4, kept.schema.field(4), pa.array(np.ones(len(kept), bool)))
    return kept, rows.filter(pa.array(open_)), rows.filter(pa.array(passed))


def _moved(parts: pa.Array) -> np.ndarray:
    """Whether a row's part differs from that of the row before."""
    x = parts.fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)


def _capped(df: DataFrame, rate: float, base: int, more_than: int, when: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    w = Window.partitionBy("clip")
    span = (F.max("t").over(w) - F.min("t").over(w)) / 1e6
    n = F.count("*").over(w)
    out = df.withColumn("_n", n).withColumn("_span", F.when(F.col("_n") > 1, span).otherwise(F.lit(1.0)))
    cap = F.floor(F.col("_span") * rate) + base
    applies = F.col("_n") > more_than if when is None else when(F.col("_n"), F.col("_span"))
    place = F.row_number().over(Window.partitionBy("clip").orderBy(F.col("conf").desc(), "t", "id"))
    return out.withColumn("_place", place).where(~applies | (F.col("_place") <= cap)).drop("_n", "_span", "_place")


def rate_cap(df: DataFrame, rate: float = 6.0, base: int = 2) -> DataFrame:
    """In clips of more than two rows, the best floor(duration x rate) + base rows."""
    return _capped(df, rate, base, 2)


def rate_limit(df: DataFrame, most: float = 6.0, rate: float = 3.0, base: int = 5) -> DataFrame:
    """In clips of more than `most` rows a second, the best floor(duration x rate) + base rows."""
    return _capped(df, rate, base, 0, lambda n, span: F.coalesce(F.try_divide(n, span), F.lit(0.0)) > most)


def legacy_cap(df: DataFrame, rate: float = 1.5, base: int = 3) -> DataFrame:
    """In clips of more than ten rows, the best floor(duration x rate) + base rows."""
    return _capped(df, rate, base, 10)


def post_filter(df: DataFrame, least: float = 0.18, share: float = 0.4, more_than: int = 5) -> DataFrame:
    """In clips of more than five rows, those of at least max(least, share x median confidence)."""
    stats = df.groupBy("clip").agg(F.expr("percentile(conf, 0.5)").alias("_median"), F.count("*").alias("_n"))
    keep = (F.col("_n") <= more_than) | (F.col("conf") >= F.greatest(F.lit(least), share * F.col("_median")))
    return df.join(stats, "clip").where(keep).drop("_median", "_n")


def dominant_cluster(df: DataFrame) -> DataFrame:
    """(clip, label, n, mean) of each clip's largest cluster: most rows, then mean confidence, then least label."""
    by = df.groupBy("clip", "label").agg(F.count("*").alias("n"), F.avg("conf").alias("mean"))
    w = Window.partitionBy("clip").orderBy(F.col("n").desc(), F.col("mean").desc(), "label")
    return by.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def kmeans_dominant(df: DataFrame, features: str = "features", k: int = 2, least: int = 6, drop: bool = True, seed: int = 0, starts: int = 10) -> DataFrame:
    """Clusters each clip's feature vectors (null: unmatched) and keeps, or marks as pov_dominant, the dominant cluster.

    Features are standardised per clip (deviation below 1e-9 counts as 1).  Unmatched rows stay and are true.  A clip
    of fewer than `least` matched rows or four samples is passed over, all true.  A clip's vectors are one group.
    """
    schema = df.drop("pov_dominant").withColumn("pov_dominant", F.lit(True)).schema

    def lloyd(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[float, np.ndarray]:
        centre = x[[rng.integers(len(x))]]
        while len(centre) < k:
            d = ((x[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.vstack([centre, x[rng.choice(len(x), p=d / d.sum())] if d.sum() else x[[0]]])
        label = np.full(len(x), -1)
        for _ in range(300):
            new = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            if (new == label).all():
                break
            label = new
            centre = np.array([x[label == j].mean(0) if (label == j).any() else centre[j] for j in range(k)])
        return float(((x - centre[label]) ** 2).sum()), label

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "id"]).reset_index(drop=True)
        rows["pov_dominant"] = True
        ok = np.flatnonzero(rows[features].notna())
        if len(ok) >= max(least, 4):
            x = np.nan_to_num(np.stack(rows[features].iloc[ok]).astype(float), posinf=0.0, neginf=0.0)
            std = x.std(0)
            x = (x - x.mean(0)) / np.where(std < 1e-9, 1.0, std)
            rng = np.random.default_rng(seed)
            _, label = min((lloyd(x, max(2, min(k, len(x) - 1)), rng) for _ in range(starts)), key=lambda r: r[0])
            conf = rows["conf"].fillna(0.5).to_numpy()[ok]
            best = max(np.unique(label), key=lambda j: ((label == j).sum(), conf[label == j].mean(), -j))
            rows.loc[ok, "pov_dominant"] = label == best
        return rows[rows["pov_dominant"]] if drop else rows

    return df.drop("pov_dominant").groupBy("clip").applyInPandas(lambda rows: mark(rows)[schema.names], schema)
