"""Joins of timed rows with a tolerance.

References and detections are (clip, id, t[, conf]) tables with t in integer microseconds.  Range joins use buckets as
wide as the range, so they are equi-joins on (clip, bucket) with a residual test.  Assignments that depend on order pass over a
clip's rows of both sides in order of time and hold those within the tolerance (see ordered); the optimal one holds what later rows may
still change.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import each_key


def range_join(left: DataFrame, right: DataFrame, before: int, after: int, strict: bool = False) -> DataFrame:
    """Pairs with left.t - before <= right.t <= left.t + after in the same clip (strictly inside if strict).

    Columns of the right side are prefixed r_ (r_id, r_t, ...).  Each pair comes once: a left row is dealt to the buckets
    its range touches, a right row to its own.
    """
    width = before + after + 1
    r = right.select(F.col("clip").alias("r_clip"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "clip"])
    r = r.withColumn("_rb", F.expr(f"floor(r_t / {width})"))
    touched = F.sequence(F.floor((F.col("t") - before) / width), F.floor((F.col("t") + after) / width))
    dealt = left.withColumn("_b", F.explode(touched))
    d = F.col("r_t") - F.col("t")
    inside = (d > -before) & (d < after) if strict else (d >= -before) & (d <= after)
    return dealt.join(r, (F.col("clip") == F.col("r_clip")) & (F.col("_b") == F.col("_rb")) & inside).drop("_b", "_rb", "r_clip")


def _within(left: DataFrame, right: DataFrame, before: int, after: int) -> DataFrame:
    """left with _hit: whether a right row lies in [t - before, t + after].

    The last right row up to t and the next one from t on decide, so no pair is made, and one exchange on clip serves both.
    """
    both = _merged(left, right.select("clip", "id", "t")).withColumn("_t", F.when(F.col("side") == 0, F.col("t")))
    w = Window.partitionBy("clip").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    r = Window.partitionBy("clip").orderBy(F.col("t").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_a", F.last("_t", ignorenulls=True).over(w)).withColumn("_b", F.last("_t", ignorenulls=True).over(r))
    hit = (F.col("t") - F.col("_a") <= before) | (F.col("_b") - F.col("t") <= after)
    return both.where("side = 1").select("l.*", F.coalesce(hit, F.lit(False)).alias("_hit"))


def semi(left: DataFrame, right: DataFrame, before: int, after: int) -> DataFrame:
    """Left rows with a right row in [t - before, t + after]."""
    return _within(left, right, before, after).where("_hit").drop("_hit")


def anti(left: DataFrame, right: DataFrame, before: int, after: int) -> DataFrame:
    """Left rows without any right row in [t - before, t + after]."""
    return _within(left, right, before, after).where("not _hit").drop("_hit")


def label(candidates: DataFrame, refs: DataFrame, before: int, after: int) -> DataFrame:
    """Candidates with label 1 if some reference r has -before <= t - r <= after, else 0."""
    return _within(candidates, refs, after, before).withColumn("label", F.col("_hit").cast("int")).drop("_hit")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each clip of a, whether the time ranges of a and b meet."""
    x = a.groupBy("clip").agg(F.min("t").alias("a0"), F.max("t").alias("a1"))
    y = b.groupBy("clip").agg(F.min("t").alias("b0"), F.max("t").alias("b1"))
    return x.join(y, "clip", "left").select("clip", F.coalesce((F.col("a1") >= F.col("b0")) & (F.col("a0") <= F.col("b1")), F.lit(False)).alias("overlap"))


def _merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides in one table: side 0 are right rows, in front of left rows of the same time."""
    value = F.struct(*[F.col(c) for c in right.columns if c != "clip"])
    kind = right.select(value.alias("v")).schema["v"].dataType
    a = right.select("clip", "t", F.lit(0).alias("side"), F.col("id").alias("_order"), value.alias("v"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("l"))
    b = left.select("clip", "t", F.lit(1).alias("side"), F.col("id").alias("_order"), F.lit(None).cast(kind).alias("v"), F.struct(*left.columns).alias("l"))
    return a.unionByName(b)


def asof_backward(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Left rows with prev, the last right row at or before t (strictly before if strict); null if none.

    Among right rows of that same time the least id is taken.
    """
    both = _merged(left, right)
    # larger ids first, so that the last one seen is the least id of its time
    order = [F.col("t"), (F.col("side").desc() if strict else F.col("side").asc()), F.col("_order").desc()]
    w = Window.partitionBy("clip").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("prev", F.last("v", ignorenulls=True).over(w)).where("side = 1").select("l.*", "prev")


def asof_nearest(left: DataFrame, right: DataFrame, tolerance: int | None = None) -> DataFrame:
    """Left rows with near, the right row of least distance (the earlier on ties, then the least id), and dt.

    Rows beyond the tolerance have null for both.  One exchange on clip; no pair is made.
    """
    both = _merged(left, right)
    w = Window.partitionBy("clip").orderBy(F.col("t"), F.col("side"), F.col("_order").desc())
    back = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the next right row is found by reading time backwards, where a frame up to the current row is running, too
    r = Window.partitionBy("clip").orderBy(F.col("t").desc(), F.col("side").desc(), F.col("_order").desc())
    ahead = F.last("v", ignorenulls=True).over(r.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("_a", back).withColumn("_b", ahead).where("side = 1")
    da, db = F.col("l.t") - F.col("_a.t"), F.col("_b.t") - F.col("l.t")
    near = F.when(F.col("_b").isNull() | (da <= db), F.col("_a")).otherwise(F.col("_b"))
    out = both.select("l.*", near.alias("near")).withColumn("dt", F.abs(F.col("near.t") - F.col("t")))
    if tolerance is not None:
        ok = F.col("dt") <= tolerance
        out = out.withColumn("near", F.when(ok, F.col("near"))).withColumn("dt", F.when(ok, F.col("dt")))
    return out


def _sides(refs: DataFrame, dets: DataFrame, keys: tuple[str, ...], limit: Column) -> DataFrame:
    """Both sides in one table: keys, t, side (1 for references), id and each reference's limit."""
    r = refs.select(*keys, "t", F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), limit.cast("double").alias("limit"))
    return r.unionByName(dets.select(*keys, "t", F.lit(0).alias("side"), F.col("id").cast("long").alias("id"), F.lit(None).cast("double").alias("limit")))


PAIR = "ref_id long, ref_t long, det_id long, det_t long"


def _with_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("dt", F.abs(F.col("det_t") - F.col("ref_t")))


def _in_turn(refs: DataFrame, dets: DataFrame, tolerance: int, keys: tuple[str, ...], limit: Column, strict: bool, behind: bool) -> DataFrame:
    """References in order of (t, id) take the nearest free detection (the earlier on ties), if within their limit.

    What was taken is no longer free; with `behind`, nor is what stands before it.
    """
    def make(emit):
        waiting: deque[tuple] = deque()
        free: list[tuple] = []  # (t, id) in order

        def settle() -> None:
            t, ref, most = waiting.popleft()
            del free[: bisect_left(free, (t - tolerance,))]
            i = bisect_left(free, (t,))
            if i and (i == len(free) or t - free[i - 1][0] <= free[i][0] - t):
                i = bisect_left(free, (free[i - 1][0],))
            d = free[i] if i < len(free) else None
            if d is not None and most is not None and (abs(d[0] - t) < most or (not strict and abs(d[0] - t) == most)):
                del free[0 if behind else i : i + 1]
                emit((ref, t, d[1], d[0]))
            else:
                emit((ref, t, None, None))

        def take(row) -> None:
            t, side, i, most = row
            while waiting and waiting[0][0] + tolerance < t:
                settle()
            if side:
                waiting.append((t, i, most))
            else:
                free.append((t, i))
                if not waiting:  # what lies further back than the tolerance is of no use to anyone to come
                    del free[: bisect_left(free, (t - tolerance,))]

        def end() -> None:
            while waiting:
                settle()
            free.clear()

        return take, end

    return _with_distance(each_key(_sides(refs, dets, keys, limit), keys, ("t", "side", "id", "limit"), ("t", "side", "id"), make, PAIR))


def match_greedy_unused(refs: DataFrame, dets: DataFrame, tolerance: int, keys: tuple[str, ...] = ("clip",), strict: bool = False, per_row: str | None = None) -> DataFrame:
    """References in time order each take the nearest detection not yet taken, if within the tolerance.

    Returns every reference, with null det_id if none.  With `strict`, closer than the tolerance.  `per_row` names a
    column of refs that holds each reference's own tolerance, at most `tolerance`.
    """
    return _in_turn(refs, dets, tolerance, keys, F.col(per_row) if per_row else F.lit(tolerance), strict, False)


def match_nearest_then_check(refs: DataFrame, dets: DataFrame, tolerance: int) -> DataFrame:
    """Each reference names the nearest of all detections within the tolerance; a detection counts for the first that names it."""
    named = asof_nearest(refs.select("clip", "id", "t"), dets.select("clip", "id", "t"), tolerance)
    turn = F.row_number().over(Window.partitionBy("clip", "near.id").orderBy("t", "id"))
    ok = F.col("near").isNotNull() & (turn == 1)
    return named.withColumn("_ok", ok).select("clip", F.col("id").alias("ref_id"), F.col("t").alias("ref_t"), F.when(F.col("_ok"), F.col("near.id")).alias("det_id"), F.when(F.col("_ok"), F.col("near.t")).alias("det_t"), F.when(F.col("_ok"), F.col("dt")).alias("dt"))


def match_order_preserving(refs: DataFrame, dets: DataFrame, tolerance: int, keys: tuple[str, ...] = ("clip",)) -> DataFrame:
    """References in time order take the nearest detection behind the last one taken, if within the tolerance."""
    return _in_turn(refs, dets, tolerance, keys, F.lit(tolerance), False, True)


class Assignment:
    """Most pairs within the tolerance, then least total distance, of references and detections that come in order of time.

    On a line some best assignment never crosses, so a table over prefixes of the detections finds it.  A reference changes the table
    only at the detections within its tolerance, so a row of it is no longer than that.  Rows are held until the best assignments
    of all prefixes still open agree on what they did: those references are decided, whatever follows, and leave.
    """

    #: References between two looks for what is decided; the looks thin out while nothing is.
    LOOK = 64

    def __init__(self, tolerance: int, emit) -> None:
        self.tolerance, self.emit = tolerance, emit
        self.clear()

    def clear(self) -> None:
        self.dets: list[tuple[int, int]] = []  # (time, id) from number `first` on
        self.first = 0
        self.waiting: deque[tuple[int, int]] = deque()  # references whose tolerance has not passed
        self.table: list[tuple] = []  # (reference, first and end number of its detections, values before and after)
        self.value, self.begin = np.zeros(1, np.int64), 0  # of the prefixes of `begin` detections and more; the last holds for all longer ones
        self.pair = 1 << max(44, int(self.tolerance).bit_length() + 8)  # the worth of a pair, more than all distances of the table
        self.look = self.LOOK

    def take(self, t: int, is_ref: bool, i: int) -> None:
        while self.waiting and self.waiting[0][0] + self.tolerance < t:
            self._row(*self.waiting.popleft())
        if is_ref:
            self.waiting.append((t, i))
        else:
            if not self.waiting:
                self._idle(t)
            self.dets.append((t, i))

    def _idle(self, t: int) -> None:
        """Without references on hand, those in the table are decided once none can meet their detections, and detections that none can reach go."""
        if self.table and t > self.table[-1][0][0] + 2 * self.tolerance:
            self._settle(np.array([self.table[-1][2]]))
        if not self.table and (n := bisect_left(self.dets, (t - self.tolerance,))) > self.LOOK:
            self._drop(n)

    def _drop(self, n: int) -> None:
        del self.dets[:n]
        self.first += n

    def _row(self, r: int, i: int) -> None:
        a = self.first + bisect_left(self.dets, (r - self.tolerance,))
        b = self.first + bisect_left(self.dets, (r + self.tolerance + 1,))
        at = np.array([t for t, _ in self.dets[a - self.first : b - self.first]], np.int64)
        if 4 * (len(self.table) + 2) * self.tolerance >= self.pair:
            pairs = (self.value + self.pair // 2) // self.pair
            self.value = pairs * (4 * self.pair) + (self.value - pairs * self.pair)
            self.pair *= 4
        before = self.value[np.minimum(np.arange(a, b + 1) - self.begin, len(self.value) - 1)]
        before = before - before[0]
        after = before.copy()
        after[1:] = np.maximum.accumulate(np.maximum(before[:-1] + self.pair - np.abs(at - r), before[1:]))
        self.table.append(((r, i), a, b, before, after))
        self.value, self.begin = after, a
        if len(self.table) >= self.look:
            self._settle(np.arange(a, b + 1))
            self.look = max(self.LOOK, 2 * len(self.table))

    @staticmethod
    def _back(row: tuple, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the number of the detection taken, -1 for none; the prefix before it) of a row entered with prefixes j."""
        _, a, b, before, after = row
        k = np.minimum(j, b) - a
        inside = np.maximum(k, 0)
        taken = (k > 0) & (after[inside] != before[inside])
        shortest = a + np.searchsorted(after, after[inside], "left") - 1  # the shortest prefix of that value
        return np.where(taken, shortest, -1), np.where(taken, shortest, j)

    def _settle(self, open_: np.ndarray) -> None:
        """Decides all references up to the last one that every open prefix enters alike."""
        j = open_
        for s in range(len(self.table) - 1, -1, -1):
            j = np.unique(np.minimum(j, self.table[s][2]))
            if len(j) == 1:
                decided = []
                for row in reversed(self.table[: s + 1]):
                    taken, j = self._back(row, j)
                    decided.append((row[0], int(taken[0])))
                for (r, i), d in reversed(decided):
                    found = self.dets[d - self.first] if d >= 0 else (None, None)
                    self.emit((i, r, found[1], found[0]))
                del self.table[: s + 1]
                self._drop((self.table[0][1] if self.table else self.begin) - self.first)
                return
            j = self._back(self.table[s], j)[1]

    def finish(self) -> None:
        """The end: one prefix is left, that of all detections."""
        while self.waiting:
            self._row(*self.waiting.popleft())
        if self.table:
            self._settle(np.array([self.first + len(self.dets)]))
        self.clear()


def best_assignment(r: np.ndarray, d: np.ndarray, tolerance: int) -> list[tuple[int, int]]:
    """Pairs (place in r, place in d) of the best assignment; r and d sorted."""
    out: list[tuple] = []
    one = Assignment(tolerance, out.append)
    for t, is_ref, i in sorted([(int(t), False, i) for i, t in enumerate(d)] + [(int(t), True, i) for i, t in enumerate(r)]):
        one.take(t, is_ref, i)
    one.finish()
    return [(i, j) for i, _, j, _ in out if j is not None]


def match_optimal(refs: DataFrame, dets: DataFrame, tolerance: int) -> DataFrame:
    """The assignment with most pairs within the tolerance and then least total distance.

    A clip's rows pass once, in order of time; what is held is the rows of Assignment's table that are not decided.
    """
    def make(emit):
        one = Assignment(tolerance, emit)
        return (lambda row: one.take(row[0], bool(row[1]), row[2])), one.finish

    return _with_distance(each_key(_sides(refs, dets, ("clip",), F.lit(None)), ("clip",), ("t", "side", "id", "limit"), ("t", "side", "id"), make, PAIR))


def cross_tolerance(a: DataFrame, b: DataFrame, least: int, most: int, share: float = 0.5) -> DataFrame:
    """(clip, tolerance): share x the median interval of both sides' merged times, held in [least, most]; most for a single time."""
    both = a.select("clip", "t", "id", F.lit(0).alias("side")).unionByName(b.select("clip", "t", "id", F.lit(1).alias("side")))
    gap = both.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("clip").orderBy("t", "side", "id")))
    m = gap.groupBy("clip").agg(F.expr("percentile(gap, 0.5)").alias("m"))
    return m.select("clip", F.coalesce(F.least(F.greatest(F.col("m") * share, F.lit(float(least))), F.lit(float(most))), F.lit(float(most))).alias("tolerance"))


def cross_validate(audio: DataFrame, motion: DataFrame, least: int, most: int, share: float = 0.5) -> DataFrame:
    """Full outer one-to-one match of two detectors: audio rows in time order take the nearest unused motion row closer
    than the clip's adaptive tolerance.  conf is the mean of both (a missing one counts 0.5)."""
    tol = cross_tolerance(audio, motion, least, most, share)
    a = audio.join(tol, "clip")
    hit = match_greedy_unused(a, motion, most, strict=True, per_row="tolerance")
    ac = audio.select("clip", F.col("id").alias("ref_id"), F.col("conf").alias("a_conf"))
    mc = motion.select("clip", F.col("id").alias("det_id"), F.col("t").alias("m_t"), F.col("conf").alias("m_conf"))
    full = hit.join(ac, ["clip", "ref_id"]).join(mc, ["clip", "det_id"], "full")
    both = F.col("ref_id").isNotNull() & F.col("det_id").isNotNull()
    conf = F.when(both, (F.coalesce("a_conf", F.lit(0.5)) + F.coalesce("m_conf", F.lit(0.5))) / 2)
    status = F.when(both, "matched").when(F.col("ref_id").isNotNull(), "audio_only").otherwise("motion_only")
    return full.select("clip", F.col("ref_id").alias("audio_id"), F.col("det_id").alias("motion_id"), status.alias("status"), conf.alias("conf"))


def recover_missed(refs: DataFrame, dets: DataFrame, candidates: DataFrame, tolerance: int, reach: int, least_conf: float, apart: int) -> DataFrame:
    """Detections with recovered ones added: each reference without a detection within the tolerance takes the nearest candidate within
    `reach` of at least `least_conf`, unless a detection or an earlier recovery lies within `apart` of it.

    It uses references to add detections, so it raises measured recall: off unless asked for.
    """
    missed = anti(refs.select("clip", "id", "t"), dets, tolerance, tolerance)
    pairs = range_join(missed, candidates.where(F.col("conf") >= least_conf).select("clip", "id", "t", "conf"), reach, reach)
    pick = F.min(F.struct(F.abs(F.col("r_t") - F.col("t")).alias("d"), F.col("r_t").alias("ct"), F.col("r_id").alias("cid"), F.col("r_conf").alias("cconf"))).alias("c")
    best = pairs.groupBy("clip", "id", "t").agg(pick).select("clip", F.col("t").alias("rt"), F.col("id").alias("rid"), F.col("c.cid").alias("id"), F.col("c.ct").alias("t"), F.col("c.cconf").alias("conf"))
    free = best.join(anti(best.select("clip", "id", "t").distinct(), dets, apart, apart).select("clip", "id"), ["clip", "id"], "left_semi")

    def make(emit):
        taken: list[int] = []

        def take(row) -> None:
            rt, rid, t, i = row
            at = bisect_left(taken, t)
            if all(abs(v - t) > apart for v in taken[max(0, at - 1) : at + 1]):
                taken.insert(at, t)
                emit((i, t))

        return take, taken.clear

    kept = each_key(free, ("clip",), ("rt", "rid", "t", "id"), ("rt", "rid", "t", "id"), make, "id long, t long").distinct()
    added = free.select("clip", "id", "t", "conf").distinct().join(kept, ["clip", "id", "t"], "left_semi").select("clip", "id", "t", "conf", F.lit(True).alias("recovered"))
    return dets.select("clip", "id", "t", "conf", F.lit(False).alias("recovered")).unionByName(added)


def window_argmax(refs: DataFrame, frames: DataFrame, before: int, after: int, value: str = "value") -> DataFrame:
    """For each reference, the first frame of greatest value with t in [ref - before, ref + after]; none, no row."""
    pairs = range_join(refs.select("clip", "id", "t"), frames.select("clip", "id", "t", F.col(value).alias("value")), before, after)
    best = F.max(F.struct(F.col("r_value").alias("v"), (-F.col("r_t")).alias("nt"), (-F.col("r_id")).alias("nid"))).alias("m")
    return pairs.groupBy("clip", "id", "t").agg(best).select("clip", F.col("id").alias("ref_id"), F.col("t").alias("ref_t"), (-F.col("m.nid")).alias("peak_id"), (-F.col("m.nt")).alias("peak_t"), F.col("m.v").alias("peak_value"))


def window_stats(refs: DataFrame, frames: DataFrame, before: int, after: int, value: str = "value") -> DataFrame:
    """window_argmax with the window's mean, deviation, extremes, rise and fall times, and means up to and from the peak.

    Means add up in order of time, so that no run differs from another in the last digit.
    """
    peak = window_argmax(refs, frames, before, after, value)
    pairs = range_join(refs.select("clip", "id", "t"), frames.select("clip", "id", "t", F.col(value).alias("value")), before, after)
    p = pairs.withColumnRenamed("id", "ref_id").drop("t").join(peak, ["clip", "ref_id"])
    at = F.struct("r_t", "r_id")
    top = F.struct(F.col("peak_t"), F.col("peak_id"))
    so_far = Window.partitionBy("clip", "ref_id").orderBy("r_t", "r_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = {"mean": F.col("r_value"), "before_peak": F.when(at <= top, F.col("r_value")), "after_peak": F.when(at >= top, F.col("r_value"))}
    p = p.withColumns({f"_{k}": F.sum(v).over(so_far) for k, v in parts.items()})
    means = [F.try_divide(F.max_by(f"_{k}", at), F.count(v)).alias(k) for k, v in parts.items()]
    out = p.groupBy("clip", "ref_id", "ref_t", "peak_id", "peak_t", "peak_value").agg(*means, F.stddev_pop("r_value").alias("std"), F.min("r_value").alias("low"), F.max("r_value").alias("high"), F.count("*").alias("n"))
    out = out.withColumn("rise", F.col("peak_t") - (F.col("ref_t") - before)).withColumn("fall", F.col("ref_t") + after - F.col("peak_t")).withColumn("offset", F.col("peak_t") - F.col("ref_t"))
    out = out.withColumn("peak_to_mean", F.when(F.col("mean") > 0, F.col("peak_value") / F.col("mean")).otherwise(0.0))
    return out.withColumn("ratio", F.col("after_peak") / (F.col("before_peak") + 1e-9))


def window_series(refs: DataFrame, frames: DataFrame, before: int, after: int, value: str = "value") -> DataFrame:
    """(clip, ref_id, series): the frames (t, value) of each reference's window in order; references without any are left out."""
    pairs = range_join(refs.select("clip", "id", "t"), frames.select("clip", "id", "t", F.col(value).alias("value")), before, after)
    row = F.struct(F.col("r_t").alias("t"), F.col("r_id").alias("id"), F.col("r_value").alias("value"))
    return pairs.groupBy("clip", F.col("id").alias("ref_id")).agg(F.array_sort(F.collect_list(row)).alias("series"))


def offset_scan(refs: DataFrame, dets: DataFrame, tolerance: int, offsets: list[int]) -> DataFrame:
    """Order-preserving matches for references moved by each offset: clip, offset, n, mae, and best (most matches, then least mae, then least offset)."""
    moved = refs.select("clip", "id", "t").withColumn("offset", F.explode(F.array(*[F.lit(int(o)).cast("long") for o in offsets]))).withColumn("t", F.col("t") + F.col("offset"))
    many = dets.select("clip", "id", "t").withColumn("offset", F.explode(F.array(*[F.lit(int(o)).cast("long") for o in offsets])))
    m = match_order_preserving(moved, many, tolerance, ("clip", "offset"))
    by = m.groupBy("clip", "offset").agg(F.count("det_id").alias("n"), F.avg("dt").alias("mae"))
    w = Window.partitionBy("clip").orderBy(F.col("n").desc(), F.col("mae").asc_nulls_last(), "offset")
    return by.withColumn("best", F.row_number().over(w) == 1)


def label_override(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows with primary: the row's own human_primary, else the override of its audit_id."""
    o = overrides.where("human_primary is not null and trim(human_primary) <> ''").groupBy("audit_id").agg(F.max("human_primary").alias("_o"))
    own = F.when(F.trim("human_primary") != "", F.col("human_primary"))
    return rows.join(o, "audit_id", "left").withColumn("primary", F.coalesce(own, F.col("_o"))).drop("_o")


def frame_labels(shots: DataFrame, fps: float) -> DataFrame:
    """One row for each labelled frame of a clip: the number, from 1, of the last shot that falls on it."""
    n = F.row_number().over(Window.partitionBy("clip").orderBy("t", "id"))
    at = shots.withColumn("shot", n).withColumn("frame", F.floor(F.col("t") * F.lit(fps) / 1e6).cast("long"))
    return at.groupBy("clip", "frame").agg(F.max("shot").alias("shot"))
