"""Searches over parameters: every setting is a key of one distributed evaluation, not a loop of jobs."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from dataclasses import replace
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.operators.metrics import with_prf
from tidemark.operators.ordered import each_key
from tidemark.params import (
    BEEP_HEIGHT_SHARES,
    BEEP_PROBES,
    CALIBRATION_COEFFICIENTS,
    CALIBRATION_DISTANCES,
    CALIBRATION_PERCENTILES,
    CALIBRATION_PROMINENCES,
    CALIBRATION_SMOOTH_COEFFICIENTS,
    CALIBRATION_SMOOTH_MS,
    CALIBRATION_SMOOTH_PROMINENCES,
    Beep,
    Legacy,
)


#: Rows between two looks for references that are decided by their place alone.
LOOK = 256


class _Suppressed:
    """One setting of a sweep of nearest-then-check matches: detections from a confidence on, after anchored suppression within a window."""

    __slots__ = ("least", "window", "anchor", "best", "seen", "hit", "next_ref", "n_det", "tp")

    def __init__(self, least: float, window: int) -> None:
        self.least, self.window = least, window
        self.clear()

    def clear(self) -> None:
        self.anchor = self.best = self.seen = None  # the open cluster's first time and (time, confidence); the last survivor's time
        self.hit, self.next_ref, self.n_det, self.tp = False, 0, 0, 0

    def detection(self, t: int, conf: float, refs: list[int], tolerance: int) -> None:
        if self.anchor is not None:
            if t - self.anchor < self.window:
                if conf > self.best[1]:
                    self.best = t, conf
                return
            self.close(refs, tolerance)
        self.anchor, self.best = t, (t, conf)

    def close(self, refs: list[int], tolerance: int) -> None:
        """The open cluster's survivor counts, and decides the references up to it."""
        t, hit = self.best[0], False
        self.anchor = None
        self.n_det += 1
        while self.next_ref < len(refs) and refs[self.next_ref] <= t:
            r = refs[self.next_ref]
            self.next_ref += 1
            if self.seen is not None and r - self.seen <= t - r:
                self._behind(r, tolerance)
            elif t - r <= tolerance:
                hit = True
        if self.seen != t:  # of survivors at one time the first is the nearest
            self.seen, self.hit = t, hit
        self.tp += hit

    def _behind(self, r: int, tolerance: int) -> None:
        if self.seen is not None and r - self.seen <= tolerance and not self.hit:
            self.hit = True
            self.tp += 1

    def settle(self, refs: list[int], now: int, tolerance: int) -> None:
        """References that no later survivor can be near to are decided by the one behind them."""
        now = now if self.anchor is None else self.anchor
        while self.next_ref < len(refs) and refs[self.next_ref] + tolerance < now:
            self._behind(refs[self.next_ref], tolerance)
            self.next_ref += 1

    def finish(self, refs: list[int], tolerance: int) -> None:
        if self.anchor is not None:
            self.close(refs, tolerance)
        for r in refs[self.next_ref :]:
            self._behind(r, tolerance)


def _swept(refs: DataFrame, dets: DataFrame, make, settings: list[dict[str, float]]) -> DataFrame:
    """(the settings' columns, n_gt, n_det, tp, fp, fn and ratios): the sums over clips of what a rule counts for each setting.

    A clip's references and detections pass once, in order of time, for all settings together, and only counts are shuffled on.
    """
    side = lambda df, k, conf: df.select("clip", "t", F.lit(k).alias("side"), "id", conf.cast("double").alias("conf"))
    rows = side(dets, 0, F.col("conf")).unionByName(side(refs, 1, F.lit(0.0)))
    per = each_key(rows, ("clip",), ("t", "side", "id", "conf"), ("t", "side", "id"), make, "setting bigint, n_gt bigint, n_det bigint, tp bigint")
    sums = per.groupBy("setting").agg(*[F.sum(c).alias(c) for c in ("n_gt", "n_det", "tp")])
    scored = with_prf(sums.withColumns({"fp": F.col("n_det") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp")}))
    names = [F.element_at(F.array(*[F.lit(x[k]) for x in settings]), (F.col("setting") + 1).cast("int")).alias(k) for k in settings[0]]
    return scored.select(*names, "n_gt", "n_det", "tp", "fp", "fn", "precision", "recall", "f1")


def grid_search(refs: DataFrame, dets: DataFrame, tolerance: int, thresholds: list[float], windows: list[int]) -> DataFrame:
    """Pooled scores of nearest-then-check matches for each confidence threshold and window of anchored suppression (0: none), and which
    is best (then the lowest of each).  One pass over the rows for all settings: see _Suppressed."""
    grid = [{"threshold": float(h), "window": int(w)} for h, w in product(thresholds, windows)]

    def make(emit):
        states = [_Suppressed(x["threshold"], x["window"]) for x in grid]
        held: list[int] = []  # the references that some setting has not decided
        n = rows = 0

        def take(row) -> None:
            nonlocal n, rows
            t, side, _, conf = row
            rows += 1
            if side:
                held.append(t)
                n += 1
            else:
                for s in states:
                    if conf is not None and conf >= s.least:
                        s.detection(t, conf, held, tolerance)
            if rows % LOOK == 0:
                for s in states:
                    s.settle(held, t, tolerance)
                done = min(s.next_ref for s in states)
                del held[:done]
                for s in states:
                    s.next_ref -= done

        def end() -> None:
            nonlocal n, rows
            for i, s in enumerate(states):
                s.finish(held, tolerance)
                emit((i, n, s.n_det, s.tp))
                s.clear()
            held.clear()
            n = rows = 0

        return take, end

    w = Window.orderBy(F.col("f1").desc(), "threshold", "window")  # one row for each setting
    return _swept(refs, dets, make, grid).withColumn("best", F.row_number().over(w) == 1)


def threshold_sweep(refs: DataFrame, dets: DataFrame, tolerance: int, thresholds: list[float]) -> DataFrame:
    """Pooled scores at each confidence threshold, and which has the best f1 (the lowest on ties): grid_search without suppression."""
    return grid_search(refs, dets, tolerance, thresholds, [0]).drop("window")


def energy_sweep(refs: DataFrame, dets: DataFrame, tolerances: list[int], thresholds: list[float], enough: float = 0.9999) -> DataFrame:
    """Scores of greedy matches by tolerance and threshold, and the first setting (tolerances in order, thresholds from the highest) whose recall is enough.

    One pass over the rows for all settings: the detections within the greatest tolerance are held once, with the settings that used each.
    """
    grid = [{"i": i, "tolerance": int(tol), "threshold": float(h)} for i, tol in enumerate(tolerances) for h in thresholds]
    far = max(int(t) for t in tolerances)

    def make(emit):
        near: deque[tuple[int, float, set[int]]] = deque()  # time, confidence, settings that used it
        waiting: deque[int] = deque()  # references whose surroundings are not complete
        n_det, tp = [0] * len(grid), [0] * len(grid)
        n = 0

        def decide(r: int) -> None:
            # in order of distance, the earlier first
            around = sorted((abs(t - r), k) for k, (t, _, _) in enumerate(near) if abs(t - r) <= far)
            for j, x in enumerate(grid):
                for dist, k in around:
                    if dist > x["tolerance"]:
                        break
                    if near[k][1] >= x["threshold"] and j not in near[k][2]:
                        near[k][2].add(j)
                        tp[j] += 1
                        break

        def take(row) -> None:
            nonlocal n
            t, side, _, conf = row
            while waiting and waiting[0] + far < t:
                decide(waiting.popleft())
            while near and near[0][0] < (waiting[0] if waiting else t) - far:
                near.popleft()
            if side:
                waiting.append(t)
                n += 1
            elif conf is not None:
                near.append((t, conf, set()))
                for j, x in enumerate(grid):
                    n_det[j] += conf >= x["threshold"]

        def end() -> None:
            nonlocal n
            while waiting:
                decide(waiting.popleft())
            for j in range(len(grid)):
                emit((j, n, n_det[j], tp[j]))
                n_det[j] = tp[j] = 0
            near.clear()
            n = 0

        return take, end

    w = Window.orderBy((F.col("recall") >= enough).desc(), "i", F.col("threshold").desc())
    return _swept(refs, dets, make, grid).withColumn("first", (F.row_number().over(w) == 1) & (F.col("recall") >= enough)).drop("i")


def calibration_score(per_setting: DataFrame, over: float = 0.10, under: float = 0.05) -> DataFrame:
    """Adds score = n - over x surplus detections + under x missing ones, and best (highest score, then least mae)."""
    extra = F.greatest(F.lit(0), F.col("n_det") - F.col("n_gt"))
    missing = F.greatest(F.lit(0), F.col("n_gt") - F.col("n_det"))
    out = per_setting.withColumn("score", F.col("n") - over * extra + under * missing)
    w = Window.orderBy(F.col("score").desc(), F.col("mae").asc_nulls_last(), "setting")
    return out.withColumn("best", F.row_number().over(w) == 1)


def calibration_grid() -> list[Legacy]:
    """The settings of the calibration search: thresholds by coefficient and by percentile, then coefficients under other smoothings."""
    out = []
    for d, p in product(CALIBRATION_DISTANCES, CALIBRATION_PROMINENCES):
        out += [Legacy(min_dist=d, prominence=p, coef=k) for k in CALIBRATION_COEFFICIENTS]
        out += [Legacy(min_dist=d, prominence=p, percentile=float(q)) for q in CALIBRATION_PERCENTILES]
    every = product(CALIBRATION_SMOOTH_MS, CALIBRATION_DISTANCES[:1], CALIBRATION_SMOOTH_PROMINENCES, CALIBRATION_SMOOTH_COEFFICIENTS)
    return out + [Legacy(smooth_ms=s, min_dist=d, prominence=p, coef=k) for s, d, p, k in every]


def _in_turn_by_setting(refs: DataFrame, found: DataFrame, tolerance: int) -> DataFrame:
    """(clip, setting, n_det, n, dt): what match_order_preserving of refs(clip, id, t) with each setting of found(clip, setting, id, t) comes to: detections, matches and
    their total distance.  Settings without detections in a clip give no row.

    A clip's references are held once for all settings, and each setting looks only at those within the tolerance of its detections: no other one can change what it matches.
    """
    def make(emit):
        held: list[int] = []  # the references' times from the first on that a setting may still match
        states: dict[int, list] = {}  # for each setting its free detections' times, its next reference, and n_det, n and dt

        def settle(state: list, before: int | None) -> None:
            """Decides the state's references whose tolerance ends before this time."""
            free, k = state[0], state[1]
            while free and k < len(held) and (before is None or held[k] + tolerance < before):
                t = held[k]
                del free[: bisect_left(free, t - tolerance)]
                k += 1
                i = bisect_left(free, t)
                if i and (i == len(free) or t - free[i - 1] <= free[i] - t):
                    i = bisect_left(free, free[i - 1])
                if i < len(free) and abs(free[i] - t) <= tolerance:
                    state[3] += 1
                    state[4] += abs(free[i] - t)
                    del free[: i + 1]
            state[1] = k

        rows = 0

        def take(row) -> None:
            nonlocal rows
            t, side, _, setting = row
            rows += 1
            if side:
                held.append(t)
            else:
                state = states.setdefault(setting, [[], 0, 0, 0, 0])
                settle(state, t)
                if not state[0]:
                    state[1] = max(state[1], bisect_left(held, t - tolerance))
                state[0].append(t)
                state[2] += 1
            if rows % LOOK == 0:
                done = bisect_left(held, t - tolerance)
                for state in states.values():
                    settle(state, t)
                    state[1] = max(0, state[1] - done)
                    del state[0][: bisect_left(state[0], (held[done] if done < len(held) else t) - tolerance)]
                del held[:done]

        def end() -> None:
            nonlocal rows
            for setting, state in states.items():
                settle(state, None)
                emit((setting, *state[2:]))
            states.clear()
            held.clear()
            rows = 0

        return take, end

    r = refs.select("clip", "t", F.lit(1).alias("side"), "id", F.lit(None).cast("int").alias("setting"))
    both = r.unionByName(found.select("clip", "t", F.lit(0).alias("side"), "id", "setting"))
    return each_key(both, ("clip",), ("t", "side", "id", "setting"), ("t", "side", "id", "setting"), make, "setting bigint, n_det bigint, n bigint, dt bigint")


def calibrate(audio: DataFrame, refs: DataFrame, tolerance: int, grid: list[Legacy] | None = None) -> DataFrame:
    """The legacy detector under every setting of the grid against refs(clip, id, t): setting (its place), n_gt, n_det, n, mae (of all clips together), score and best.

    A clip's samples are read once, and its references meet the detections of all settings in one pass.
    """
    grid = calibration_grid() if grid is None else grid
    found = detect.legacy_grid(audio, grid).select("clip.clip", "clip.setting", "id", "t")
    sums = _in_turn_by_setting(refs, found, tolerance).groupBy("setting").agg(*[F.sum(c).alias(c) for c in ("n_det", "n", "dt")])
    settings = refs.agg(F.count("*").alias("n_gt")).where("n_gt > 0").select(F.explode(F.array(*[F.lit(i) for i in range(len(grid))])).alias("setting"), "n_gt")
    per = settings.join(sums, "setting", "left").fillna(0, ["n_det", "n"])
    return calibration_score(per.select("setting", "n_gt", "n", (F.col("dt") / F.when(F.col("n") > 0, F.col("n"))).alias("mae"), "n_det"))


def tune_beeps(audio: DataFrame, truth: DataFrame, base: Beep = Beep(), decode: Callable | None = None) -> DataFrame:
    """The beep detector under 24 settings against truth(clip, t): setting, height_share, probe_from (null: no probe), mae over the clips with a beep found, and best (least mae, the first on ties).

    A clip's samples are read once for all settings.
    """
    grid = [replace(base, height_share=h, probe=(late, base.probe[1]) if probe else None) for h in BEEP_HEIGHT_SHARES for probe in (True, False) for late in BEEP_PROBES]
    found = detect.beep_grid(audio, grid, decode)
    errors = found.join(truth.select("clip", F.col("t").alias("_t")), "clip").groupBy("setting").agg(F.avg(F.abs(F.col("t") - F.col("_t"))).alias("mae"), F.count("*").alias("n"))
    names = audio.sparkSession.createDataFrame([(i, p.height_share, p.probe[0] if p.probe else None) for i, p in enumerate(grid)], "setting int, height_share double, probe_from double")
    w = Window.orderBy(F.col("mae").asc_nulls_last(), "setting")  # one row for each setting
    return names.join(errors, "setting", "left").withColumn("best", (F.row_number().over(w) == 1) & F.col("mae").isNotNull())


def verified_overrides(overrides: DataFrame, refined: DataFrame) -> DataFrame:
    """Each clip's override replaced by its refined time where there is one."""
    return overrides.join(refined.select("clip", F.col("t").alias("_r")), "clip", "left").select("clip", F.coalesce("_r", "t").alias("t"), F.col("_r").isNotNull().alias("verified"))
