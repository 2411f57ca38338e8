"""Detectors over signals.  A clip's samples are one row (clip, sr, samples), decoded by the sources; a detector is a
kernel over rows of a partition, with the selection rules behind it in the native operators.

Where a detector takes `decode`, samples may be any value of which decode(value) makes the array: it is called in the task for one
clip at a time, so that decoded sounds are never rows, and no batch holds those of many clips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators import dedup, kernels, matching, metrics, score
from tidemark.operators.signal import candidate_features, features_of_means
from tidemark.params import Beep, Candidates, Energy, Legacy, Motion, Selection, Stft, micros
from tidemark.shared import checkpoint

SHOT = "clip string, id long, t long, conf double, value double"
#: Rows that a task gathers from its clips before it hands them on.
ROWS = 1 << 14
#: Clips of a batch that are Python values at once.
CLIPS = 16


def _shots(clip, t: np.ndarray, conf: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """Times to four decimals of a second, as they are reported."""
    return pd.DataFrame({"clip": [clip] * len(t), "id": np.arange(len(t)), "t": np.array([_reported(v) for v in t], np.int64), "conf": conf, "value": value})


def _reported(seconds: float) -> int:
    """A time as it is reported, to four decimals of a second, in microseconds."""
    return round(round(float(seconds), 4) * 1e6)


def _cells(column: pa.Array) -> list:
    """Python values of a column; lists of numbers are arrays (null: NaN), and a null list is None."""
    if not isinstance(column, (pa.ListArray, pa.LargeListArray)):
        return column.to_pylist()
    if _number(column.type.value_type):
        return [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in column]
    rows = column.flatten()
    if not pa.types.is_struct(rows.type) or column.null_count or rows.null_count:
        return column.to_pylist()
    # field by field, which takes a quarter of the time
    names = [field.name for field in rows.type]
    values = (v.to_numpy(zero_copy_only=False).tolist() if _number(v.type) and not v.null_count else v.to_pylist() for v in rows.flatten())
    made = [dict(zip(names, row)) for row in zip(*values)]
    edges = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    return [made[a:b] for a, b in zip(edges, edges[1:])]


def _number(kind: pa.DataType) -> bool:
    return pa.types.is_floating(kind) or pa.types.is_integer(kind)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, a few at a time: a batch may hold the samples of ten thousand clips, which are many times larger as Python values."""
    for batch in batches:
        for a in range(0, len(batch), CLIPS):
            yield from zip(*map(_cells, batch.slice(a, CLIPS).columns))


def _batch(held: list, kind: pa.Schema) -> pa.RecordBatch:
    """What a kernel gave for some clips, frames or mappings of names to arrays, as one batch."""
    if isinstance(held[0], pd.DataFrame):
        return pa.RecordBatch.from_pandas(pd.concat(held, ignore_index=True), kind, preserve_index=False)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[f.name] for h in held]), f.type, from_pandas=True) for f in kind], schema=kind)


def _each(kernel, audio: DataFrame, schema: str, columns: tuple[str, ...] = ("clip", "sr", "samples"), decode: Callable | None = None) -> DataFrame:
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for row in _clips(batches):
            if decode is not None:
                row = tuple(decode(v) if c == "samples" else v for c, v in zip(columns, row))
            out = kernel(*row)
            rows = 0 if out is None else len(out["clip"])
            if rows:
                held.append(out)
                n += rows
            if n >= ROWS:
                yield _batch(held, kind)
                held, n = [], 0
        if held:
            yield _batch(held, kind)

    return audio.select(*columns).mapInArrow(run, schema)


def stft_frames(audio: DataFrame, p: Stft = Stft()) -> DataFrame:
    """(clip, idx, mag) of every frame."""
    def kernel(clip, sr, x):
        m = kernels.stft(np.asarray(x, float), p.n_fft, p.hop)
        return pd.DataFrame({"clip": clip, "idx": np.arange(len(m)), "mag": list(m)})

    return _each(kernel, audio, "clip string, idx long, mag array<double>")


def energy_shots(audio: DataFrame, p: Energy = Energy()) -> DataFrame:
    """Peaks of the normalised envelope above the threshold; conf 1, value the envelope.  A silent clip has none."""
    def kernel(clip, sr, x):
        e = kernels.moving_average(np.abs(kernels.crack_band(np.asarray(x, float), sr, p.low_hz, p.high_hz)), max(1, int(sr * p.smooth)))
        if not len(e) or e.max() <= 1e-12:
            return None
        e = e / e.max()
        at = kernels.find_peaks(e, p.threshold, max(1, int(sr * p.min_distance)))
        return _shots(clip, at / sr, np.ones(len(at)), e[at])

    return _each(kernel, audio, SHOT)


def legacy_grid(audio: DataFrame, grid: list[Legacy]) -> DataFrame:
    """legacy_shots under every setting; clip is a struct of clip and setting, its place in the grid.  A clip is filtered once for each band."""
    def kernel(clip, sr, x):
        x = np.asarray(x, float)
        if not len(x):
            return None
        bands, curves, thinned = {}, {}, {}
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for i, p in enumerate(grid):
            key = (p.band, p.envelope)
            if key not in bands:
                bands[key] = kernels.moving_average(np.abs(kernels.crack_band(x, sr, *p.band)), max(1, int(sr * p.envelope)))
            key = (*key, max(1, int(sr * p.smooth_ms / 1000)))
            if key not in curves:
                # what settings of one smoothing share: the curve, its maxima with their prominences, and its levels
                e = kernels.moving_average(bands[key[:2]], key[2])
                tops = kernels.find_maxima(e)
                shares = sorted({q.percentile for q in grid if q.percentile is not None})
                curves[key] = e, tops, kernels.prominences(e, tops), np.median(e), e.std(), dict(zip([95, *shares], np.percentile(e, [95, *shares])))
            e, tops, rises, base, std, levels = curves[key]
            height = base + p.coef * max(std, 1e-9) if p.percentile is None else levels[p.percentile]
            distance = max(1, int(sr * p.min_dist))
            key = (*key, height, distance)
            if key not in thinned:
                high = np.flatnonzero(e[tops] >= height)
                thinned[key] = high[kernels.thin_by_height(tops[high], e[tops[high]], distance)] if distance > 1 else high
            at = thinned[key]
            at = at[rises[at] >= max(p.prominence * max(std, 0.3 * (levels[95] - base)), 1e-9)]
            if len(at):
                share = [v / v.max() if v.max() > 0 else np.full(len(at), 0.5) for v in (e[tops[at]], rises[at])]
                conf = np.round(0.6 * share[0] + 0.4 * share[1], 3)
                keep = conf >= p.least if p.least > 0 else np.ones(len(at), bool)
                found.append((i, tops[at][keep], conf[keep], e[tops[at]][keep]))
        if not found:
            return None
        at, conf, value = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
        setting = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        shots = _shots(clip, at / sr, conf, value).assign(id=np.concatenate([np.arange(len(f[1])) for f in found]), setting=setting)
        return shots.assign(post=np.array([p.post_filter for p in grid])[setting], gap=np.array([micros(p.gap) for p in grid])[setting])

    found = _each(kernel, audio, f"{SHOT}, setting int, post boolean, gap long")
    # few rows for each clip, which what follows reads several times
    found = checkpoint(found.withColumn("clip", F.struct("clip", "setting")).drop("setting"))
    # more than five shots are filtered, and only then joined and capped, whatever the filter leaves
    many = found.withColumn("_many", F.col("post") & (F.count("*").over(Window.partitionBy("clip")) > 5)).drop("post")
    few = many.where("not _many").select("clip", "id", "t", "conf")
    gaps = {micros(p.gap) for p in grid}
    for gap in sorted(gaps):
        part = many.where(F.col("_many") & (F.col("gap") == gap)).select("clip", "id", "t", "conf")
        few = few.unionByName(dedup.legacy_cap(dedup.dedup_last_kept(dedup.post_filter(part), gap)))
    return few


def legacy_shots(audio: DataFrame, p: Legacy = Legacy()) -> DataFrame:
    """Peaks of the band-passed, twice smoothed envelope by height and prominence; of more than five, those that pass the
    post-filter, de-duplicated by the running best, and capped."""
    return legacy_grid(audio, [p]).withColumn("clip", F.col("clip.clip"))


def _motion_curve(values, fps: float, p: Motion) -> np.ndarray:
    """A motion series over its maximum, smoothed over an odd number of frames."""
    x = np.asarray(values, float)
    top = x.max(initial=0)
    k = max(3, int(fps * p.smooth))
    return kernels.moving_average(x / top if top > 0 else x, k | 1)


def _motion_shots(clip, fps: float, s: np.ndarray, at: np.ndarray, top: float) -> pd.DataFrame:
    return _shots(clip, at / fps, s[at] / top if top > 0 else np.full(len(at), 0.5), s[at])


def motion_peaks(series: DataFrame, p: Motion = Motion(), refs: DataFrame | None = None) -> DataFrame:
    """Peaks of a motion series (clip, fps, values, directions): normalised, smoothed, above median + 2 deviations and `least`.

    Series of fewer than ten frames have none.  With directions, only recoil directions stay.
    """
    def kernel(clip, fps, values, directions):
        s = _motion_curve(values, fps, p)
        if len(s) < 10:
            return None
        base = np.median(s)
        rise = p.prominence * (s.max() - base)
        at = kernels.find_peaks(s, max(base + p.deviations * s.std(), p.least), max(1, int(fps * p.distance)), rise)
        if directions is not None and len(directions) == len(s):
            at = at[np.array([recoil(directions[i]) for i in at], bool)]
        return _motion_shots(clip, fps, s, at, s[at].max(initial=0))

    return _each(kernel, series, SHOT, ("clip", "fps", "values", "directions"))


def recoil(degrees: float) -> bool:
    return -135 <= degrees <= -45 or 135 <= degrees <= 180 or -180 <= degrees <= -135


def motion_learned(series: DataFrame, before: float = 0.02, after: float = 0.08, p: Motion = Motion()) -> DataFrame:
    """Motion peaks with the threshold learned at the references: max(their 30th percentile, half of median + 1.5 deviations).

    series: clip, fps, values, refs (seconds).  Returns the peaks of the whole series; those at the references if there are none.
    """
    def kernel(clip, fps, values, refs):
        s = _motion_curve(values, fps, p)
        if not len(s):
            return None
        t = np.arange(len(s)) / fps
        spans = [np.flatnonzero((t >= r - before) & (t <= r + after)) for r in ([] if refs is None else refs)]
        guided = np.array([i[s[i].argmax()] for i in spans if len(i)], int)
        at = np.unique(guided)
        if len(guided) and len(s) >= 10:
            base = np.median(s)
            height = max(np.percentile(s[guided], 30), 0.5 * (base + 1.5 * s.std()))
            found = kernels.find_peaks(s, height, max(1, int(fps * p.distance)), 0.05 * (s.max() - base))
            at = found if len(found) else at
        return _motion_shots(clip, fps, s, at, s.max())

    return _each(kernel, series, SHOT, ("clip", "fps", "values", "refs"))


def _beep_envelope(x: np.ndarray, sr: float, p: Beep) -> np.ndarray:
    return kernels.moving_average(np.abs(kernels.bandpass(x, sr, p.low_hz, p.high_hz)), max(1, int(sr * p.smooth)))


def _beep_peaks(s: np.ndarray, sr: float, p: Beep) -> np.ndarray:
    """Places of the peaks above the head's mean by some deviations."""
    head = s[: int(sr * p.head)]
    return kernels.find_peaks(s, head.mean() + p.deviations * max(head.std(), 1e-12), int(sr * p.distance)) if len(head) else np.zeros(0, np.int64)


def _beep_candidates(s: np.ndarray, sr: float, p: Beep, at: np.ndarray | None = None) -> np.ndarray:
    """Times of the strong peaks: of _beep_peaks those inside the searched range if any is, of at least a share of the highest."""
    at = _beep_peaks(s, sr, p) if at is None else at
    t = at / sr
    early_enough = t <= min(p.search_to, len(s) / sr - 0.5)
    searched = early_enough & (t >= p.search_from)
    t, height = (v[searched if searched.any() else early_enough] for v in (t, s[at]))
    return t[height >= p.height_share * height.max(initial=0)]


def _tonal(x: np.ndarray, sr: float, t: float, p: Beep) -> bool:
    f = kernels.dominant_freq(x, sr, t, p.analysis)
    return f is not None and p.tonal_low <= f <= p.tonal_high


def _nearest_beep(s: np.ndarray, sr: float, about: float, window: float, p: Beep) -> float | None:
    """The peak of an envelope nearest to `about` at the first threshold of the ladder that has one."""
    a, b = int(max(0.0, about - window) * sr), int(min(len(s) / sr, about + window) * sr)
    part = s[a:b]
    if not len(part) or len(part) < int(sr * 0.1) or part.std() < 1e-9:
        return None
    for k in p.ladder:
        at = kernels.find_peaks(part, part.mean() + k * part.std(), int(sr * p.near_distance))
        if len(at):
            t = (a + at) / sr
            return round(float(t[np.abs(t - about).argmin()]), 4)
    return None


def beep_near_kernel(x: np.ndarray, sr: float, about: float, window: float = 2.0, p: Beep = Beep()) -> float | None:
    """The beep nearest to `about`, within the window."""
    return _nearest_beep(_beep_envelope(x, sr, p), sr, about, window, p)


def _scored_steps(x: np.ndarray, sr: float, p: Beep, score) -> tuple[np.ndarray, np.ndarray]:
    """(times of tonal windows in steps through the searched range, their probabilities by the network)."""
    t = p.search_from + p.step * np.arange(max(0, int((min(p.search_to, len(x) / sr - 0.4) - p.search_from) / p.step + 1e-9) + 1))
    t = t[[_tonal(x, sr, v, p) for v in t]] if len(t) else t
    return t, np.asarray(score(np.stack([kernels.beep_patch(x, sr, v) for v in t])), float) if len(t) else np.zeros(0)


def _one_beep(x: np.ndarray, sr: float, p: Beep, s: np.ndarray, score, peaks: np.ndarray | None = None) -> float | None:
    """The start beep: by the network's windows where it has any that is likely enough, else by rule; then looked for elsewhere if it lies where first shots lie."""
    t0, candidates = None, np.zeros(0)
    if score is not None:
        t, q = _scored_steps(x, sr, p, score)
        if (q >= p.probability).any():
            t0 = t[q >= p.probability][0]
        elif q.max(initial=0) >= p.fallback:
            t0 = t[q.argmax()]
        if t0 is not None:
            near = _nearest_beep(s, sr, t0, p.refine, p)
            t0 = t0 if near is None else near
    if t0 is None:
        candidates = _beep_candidates(s, sr, p, peaks)
        if not len(candidates):
            return None
        gap = np.diff(candidates, prepend=-np.inf)
        alone = candidates[gap > p.isolated]
        order = alone if len(alone) else candidates
        order = order[order <= order[0] + p.tonal_span]
        if score is not None:
            q = np.asarray(score(np.stack([kernels.beep_patch(x, sr, v) for v in order])), float)
            t0 = order[q.argmax()] if q.max() >= p.fallback else None
        if t0 is None:
            t0 = next((v for v in order if _tonal(x, sr, v, p)), order[0])
        if p.early[0] < t0 < p.early[1] and not (candidates >= p.late).any():
            near = _nearest_beep(s, sr, p.early_at, p.early_window, p)
            if near is not None and p.early_found[0] <= near <= p.early_found[1]:
                t0 = max(near, p.early_floor)
    if p.probe is not None:
        first_shot = ((candidates > p.probe[0]) & (candidates < p.probe[1])).any()
        if p.probe[0] < t0 < p.probe[1] or (t0 < p.late and first_shot):
            near = _nearest_beep(s, sr, p.probe_at, p.probe_window, p)
            if near is not None and p.search_from <= near <= p.probe_to:
                t0 = near
    return float(t0)


def _all_beeps(x: np.ndarray, sr: float, p: Beep, s: np.ndarray, score, min_gap: float) -> list[float]:
    """Tonal peaks at least min_gap apart, each looked for in its neighbourhood and, if several, kept only if still tonal (and likely to the network)."""
    if score is not None:
        t, q = _scored_steps(x, sr, p, score)
        coarse: list[tuple[float, float]] = []
        for v, w in zip(t[q >= p.probability].tolist(), q[q >= p.probability].tolist()):
            if coarse and v - coarse[-1][0] < min_gap:
                coarse[-1] = max(coarse[-1], (v, w), key=lambda c: c[1])
            else:
                coarse.append((v, w))
        places = [v for v, _ in coarse]
    else:
        places = []
        for v in _beep_candidates(s, sr, p).tolist():
            if _tonal(x, sr, v, p) and (not places or v - places[-1] >= min_gap):
                places.append(v)
    found = [v if (near := _nearest_beep(s, sr, v, p.refine, p)) is None else near for v in places]
    if len(found) > 1:
        found = [v for v in found if _tonal(x, sr, v, p)]
        if score is not None and found:
            sure = np.asarray(score(np.stack([kernels.beep_patch(x, sr, v) for v in found])), float) >= p.probability
            found = [v for v, ok in zip(found, sure) if ok]
    return found


def beeps(audio: DataFrame, p: Beep = Beep(), first_only: bool = True, min_gap: float = 1.5, load=None, decode: Callable | None = None) -> DataFrame:
    """The start beep of each clip, or all its beeps.  Clips without one give no row.

    load() returns a network: a function from a batch of patches to probabilities.  Without one the rules decide.
    """
    def kernel(clip, sr, x):
        x = np.asarray(x, float)
        score = load() if load else None
        s = _beep_envelope(x, sr, p)
        if first_only:
            t = _one_beep(x, sr, p, s, score)
            found = [] if t is None else [t]
        else:
            found = _all_beeps(x, sr, p, s, score, min_gap)
        return _shots(clip, np.array(found, float), np.full(len(found), 0.95), np.zeros(len(found)))

    return _each(kernel, audio, SHOT, decode=decode)


def beep_grid(audio: DataFrame, grid: list[Beep], decode: Callable | None = None) -> DataFrame:
    """(clip, setting, t): the start beep by rule under every setting, its place in the grid."""
    def kernel(clip, sr, x):
        x = np.asarray(x, float)
        envelopes, peaks, out = {}, {}, []
        for i, p in enumerate(grid):
            key = (p.low_hz, p.high_hz, p.smooth)
            if key not in envelopes:
                envelopes[key] = _beep_envelope(x, sr, p)
            height = (*key, p.head, p.deviations, p.distance)
            if height not in peaks:
                peaks[height] = _beep_peaks(envelopes[key], sr, p)
            t = _one_beep(x, sr, p, envelopes[key], None, peaks[height])
            if t is not None:
                out.append((clip, i, _reported(t)))
        return pd.DataFrame(out, columns=["clip", "setting", "t"])

    return _each(kernel, audio, "clip string, setting int, t long", decode=decode)


def beep_near(audio: DataFrame, window: float = 2.0, p: Beep = Beep()) -> DataFrame:
    """(clip, t): the beep near each clip's `about` seconds; clips without one give no row."""
    def kernel(clip, sr, x, about):
        t = None if about is None else beep_near_kernel(np.asarray(x, float), sr, about, window, p)
        return None if t is None else pd.DataFrame({"clip": [clip], "t": [round(t * 1e6)]})

    return _each(kernel, audio, "clip string, t long", ("clip", "sr", "samples", "about"))


def at_marks(audio: DataFrame, marks: DataFrame, measure, schema: str) -> DataFrame:
    """clip, id, t and what measure(samples, rate, seconds) returns, a tuple of the schema, for every mark (clip, id, t); a clip's samples come once for all its marks."""
    listed = marks.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("marks"))
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(clip, sr, x, found):
        x = np.asarray(x, float)
        rows = [(clip, m["id"], m["t"], *measure(x, sr, m["t"] / 1e6)) for m in found]
        return pd.DataFrame(rows, columns=["clip", "id", "t", *names])

    return _each(kernel, audio.join(listed, "clip"), f"clip string, id long, t long, {schema}", ("clip", "sr", "samples", "marks"))


def dominant_frequencies(audio: DataFrame, marks: DataFrame, seconds: float = 0.3) -> DataFrame:
    """clip, id, t, hz: the dominant frequency from every mark on; null where too little sound is left."""
    return at_marks(audio, marks, lambda x, sr, t: (kernels.dominant_freq(x, sr, t, seconds),), "hz double")


def mel_patches(audio: DataFrame, marks: DataFrame, **options) -> DataFrame:
    """clip, id, t, patch: the mel patch around every mark, band by band."""
    return at_marks(audio, marks, lambda x, sr, t: (kernels.mel_patch(x, sr, t, **options).astype(float).tolist(),), "patch array<array<double>>")


def mel_training_set(audio: DataFrame, candidates: DataFrame, refs: DataFrame, starts: DataFrame, label_before: int, label_after: int, **options) -> DataFrame:
    """clip, id, t, label, patch: the candidates from their clip's start (clip, t) on, labelled by the references around them, each with its patch."""
    first = starts.groupBy("clip").agg(F.min("t").alias("_start"))
    late = candidates.join(first, "clip").where("t >= _start").select("clip", "id", "t")
    labelled = matching.label(late, refs, label_before, label_after)
    return mel_patches(audio, late, **options).join(labelled.select("clip", "id", "label"), ["clip", "id"])


FRAME = "clip string, idx long, rate double, before int, after int, onset double, threshold double, peak boolean, e_low double, e_mid double, e_high double, flatness double, attack double, mfcc double, frame_t long, onset_t long, envelope_t long"


def _band(n_fft: int, sr: float, low: float, high: float, closed: bool = False) -> slice:
    """The bins of the frequencies in [low, high), or in [low, high] if closed."""
    freq = np.fft.rfftfreq(n_fft, 1 / sr)
    return slice(int(np.searchsorted(freq, low)), int(np.searchsorted(freq, high, "right" if closed else "left")))


def _frame_peaks(x: np.ndarray, sr: float, stft: Stft, c: Candidates) -> tuple[np.ndarray, ...]:
    """(magnitudes, onset, threshold, the frames that are peaks) of one clip."""
    m = kernels.stft(x, stft.n_fft, stft.hop)
    n, rate = len(m), sr / stft.hop
    frames = lambda seconds: int(sr * seconds / stft.hop)
    heard = _band(stft.n_fft, sr, stft.low_hz, stft.high_hz, True)
    onset = np.zeros(n)
    logs = np.zeros((min(n, kernels.FRAMES + 1), m.shape[1]))
    rise = np.empty_like(logs)
    for a in range(0, n - 1, kernels.FRAMES):
        k = min(kernels.FRAMES, n - 1 - a)
        np.log1p(m[a : a + k + 1, heard], out=logs[: k + 1, heard])
        np.subtract(logs[1 : k + 1], logs[:k], out=rise[:k])
        onset[a + 1 : a + k + 1] = np.maximum(rise[:k], 0, out=rise[:k]).sum(1)
    onset = kernels.moving_average(onset, max(1, frames(0.01)))
    if c.threshold == "mad":
        limit = mad_curve(onset, rate, c.window, c.mad_k)
    elif c.threshold == "multi":
        limit = multi_curve(onset, rate)
    else:
        limit = np.full(n, np.percentile(onset, float(c.threshold)))
    gap = max(1, frames(c.min_distance))
    at = kernels.find_peaks(onset, distance=gap)
    at = at[onset[at] >= limit[at]]
    return m, onset, limit, kernels.recover_second(onset, limit, at, c.recovery_ratio, max(1, frames(c.recovery_from)), min(n - 1, frames(c.recovery_to)), gap)


def _energies(m: np.ndarray, sr: float, stft: Stft) -> dict[str, np.ndarray]:
    """The band energies and the flatness of frames."""
    e = {k: (m[:, _band(stft.n_fft, sr, a, b)] ** 2).sum(1) for k, (a, b) in zip(("e_low", "e_mid", "e_high"), stft.bands)}
    return e | {"flatness": flatness(m)}


def _marked(env: np.ndarray, sr: float, hop: int, at: np.ndarray, s: Selection) -> dict[str, list[int]]:
    """The reported times of peaks, of their frames and moved to the onset and to the envelope's peak."""
    own = [_reported(i * hop / sr) for i in at.tolist()]
    moved = {k: own.copy() for k in ("frame_t", "onset_t", "envelope_t")}
    half = int(np.rint(sr * s.refine / 2))
    for k, centre in enumerate(np.rint(np.round(at * hop / sr, 4) * sr).astype(np.int64).tolist()):
        part, a = _around(env, centre, half)
        if len(part) >= 4:
            loud = part >= s.onset_share * (part.max() + 1e-12) if s.onset_share > 0 else np.zeros(1, bool)
            first = int(loud.argmax())
            moved["onset_t"][k] = _reported((a + (first if loud[first] else int(np.diff(part).argmax()))) / sr)
        if len(part) >= 2:
            moved["envelope_t"][k] = _reported((a + int(part.argmax())) / sr)
    return moved


def _reach(sr: float, stft: Stft, c: Candidates) -> tuple[int, int]:
    """The frames before and after a peak that its features span."""
    return max(1, int(sr * c.before / stft.hop)), max(1, int(sr * c.after / stft.hop))


def frame_features(audio: DataFrame, stft: Stft = Stft(), c: Candidates = Candidates(), s: Selection = Selection(), mfcc: bool = False, decode: Callable | None = None) -> DataFrame:
    """Every frame's onset, threshold, band energies, flatness and attack, and if asked for the peaks' cepstral band (else 0), in one pass over the samples.

    rate is frames a second; before and after are a feature window's frames at the clip's own rate.  Reported times of a frame: its own, and
    for peaks those moved to the onset and to the envelope's peak.
    """
    def kernel(clip, sr, x):
        x = np.asarray(x, float)
        m, onset, limit, at = _frame_peaks(x, sr, stft, c)
        n = len(m)
        env = kernels.moving_average(np.abs(x), max(1, int(sr * c.envelope)))
        frame_t = np.array([_reported(i * stft.hop / sr) for i in range(n)])
        moved = {k: frame_t.copy() for k in ("frame_t", "onset_t", "envelope_t")}
        for k, t in _marked(env, sr, stft.hop, at, s).items():
            moved[k][at] = t
        band = np.zeros(n)
        if mfcc:
            band[at] = kernels.mfcc_bands(x, sr, (at * stft.hop / sr).tolist())
        before, after = _reach(sr, stft, c)
        return pd.DataFrame({"clip": clip, "idx": np.arange(n), "rate": sr / stft.hop, "before": before, "after": after, "onset": onset, "threshold": limit, "peak": np.isin(np.arange(n), at), **_energies(m, sr, stft), "attack": attack_frames(env, sr, c.attack, stft.hop, n), "mfcc": band, **moved})

    return _each(kernel, audio, FRAME, decode=decode)


def peak_features(audio: DataFrame, stft: Stft = Stft(), c: Candidates = Candidates(), s: Selection = Selection(), mfcc: bool = False, decode: Callable | None = None) -> DataFrame:
    """The candidate features of every peak, with the columns of frame_features at it: a clip's frames stay in the task that makes them,
    and what only peaks need is made of the frames around them."""
    def kernel(clip, sr, x):
        _keep_memory()
        x = np.asarray(x, float)
        m, onset, limit, at = _frame_peaks(x, sr, stft, c)
        n, p = len(m), len(at)
        if not p:
            return None
        env = kernels.moving_average(np.abs(x), max(1, int(sr * c.envelope)))
        attack = attack_frames(env, sr, c.attack, stft.hop, n)
        before, after = _reach(sr, stft, c)
        low, high = np.maximum(at - before, 0), np.minimum(at + after + 1, n)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, high, -1)
        near = np.cumsum(edge[:-1]) > 0
        place = np.cumsum(near) - 1
        means = {k: _by_window(np.add, v, place[low], place[high - 1] + 1) / (high - low) for k, v in _energies(m[near], sr, stft).items()}
        return {
            "clip": np.full(p, clip, object), "idx": at, "rate": np.full(p, sr / stft.hop), "before": np.full(p, before), "after": np.full(p, after), "onset": onset[at], "threshold": limit[at], "peak": np.ones(p, bool),
            **means, "attack": _by_window(np.maximum, attack, low, high), "mfcc": kernels.mfcc_bands(x, sr, (at * stft.hop / sr).tolist()) if mfcc else np.zeros(p), **_marked(env, sr, stft.hop, at, s), "ref": np.full(p, np.percentile(attack, 99.5)),
        }

    return features_of_means(_each(kernel, audio, f"{FRAME}, ref double", decode=decode), "ref")


def _by_window(reduce: np.ufunc, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """x[low : high], which are not empty, reduced to a value each."""
    return reduce.reduceat(np.append(x, 0), np.stack([low, high], 1).ravel())[::2]


@lru_cache(maxsize=1)
def _keep_memory() -> None:
    """Once in a process, a large array is made and freed, untouched: the allocator then keeps what clips free up to twice its size, instead of asking for it anew for
    every clip, whose pages take longer than much of what is done in them."""
    np.empty(31 << 17)


def flatness(m: np.ndarray) -> np.ndarray:
    """Of each frame, the geometric mean of the magnitudes that aren't silence over the mean of all."""
    ok = m > 1e-9
    if ok.all():
        return np.exp(np.log(m).sum(1) / m.shape[1]) / (m.mean(1) + 1e-9)
    logs = np.where(ok, np.log(np.where(ok, m, 1)), 0).sum(1) / np.maximum(ok.sum(1), 1)
    return np.where(ok.any(1), np.exp(logs) / (m.mean(1) + 1e-9), 0)


def _around(x: np.ndarray, at: int, half: int) -> tuple[np.ndarray, int]:
    """x[at - half : at + half] as far as it reaches, and where it begins."""
    a = max(0, at - half)
    return x[a : max(a, min(len(x), at + half))], a


def attack_curve(env: np.ndarray, sr: float, seconds: float) -> np.ndarray:
    """The steepest rise between neighbours in the samples before each, over the window's seconds; 0 where the window doesn't fit."""
    k = max(1, int(sr * seconds))
    slope = np.zeros(len(env))
    if len(env) > k:
        slope[k:] = np.lib.stride_tricks.sliding_window_view(np.diff(env), k).max(1) / (k / sr)
    return slope


def attack_frames(env: np.ndarray, sr: float, seconds: float, hop: int, n: int) -> np.ndarray:
    """The greatest attack_curve in each of n frames of `hop` samples, 0 behind the end."""
    k = max(1, int(sr * seconds))
    begin = np.arange(n) * hop
    low, high = np.maximum(begin, k), np.minimum(begin + hop, len(env))
    out = np.zeros(n)
    some = np.flatnonzero(low < high)
    if len(some):
        top = _by_window(np.maximum, np.diff(env), low[some] - k, high[some] - 1) / (k / sr)
        whole = (begin[some] >= k) & (begin[some] + hop <= len(env))
        out[some] = np.where(whole, top, np.maximum(top, 0))
    return out


def _windows(x: np.ndarray, step: int, w: int) -> tuple[np.ndarray, list[np.ndarray]]:
    at = np.arange(0, len(x), step)
    return at, [x[max(0, i - w // 2) : i + w // 2] for i in at]


def _median(x: np.ndarray) -> float:
    """np.median of a short array, of which it does the work alone."""
    x = np.sort(x)
    return x[-1] if np.isnan(x[-1]) else (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2


def mad_curve(x: np.ndarray, rate: float, window: float, k: float) -> np.ndarray:
    """The adaptive threshold of one array: median + k deviations at every quarter window, interpolated."""
    w = max(10, min(int(rate * window), len(x) // 4))
    at, parts = _windows(x, max(1, w // 4), w)
    points = []
    for part in parts:
        med = _median(part)
        mad = _median(np.abs(part - med))
        points.append(med + k * (1.4826 * mad if mad > 0 else part.std()))
    return np.interp(np.arange(len(x)), at, points)


def multi_curve(x: np.ndarray, rate: float, short: float = 0.5, long: float = 3.0, k_short: float = 4.0, k_long: float = 2.5) -> np.ndarray:
    """The greater of a short and a long window's median + k deviations, both at every quarter of the long window, interpolated."""
    ws = max(10, min(int(rate * short), len(x) // 4))
    wl = max(ws, min(int(rate * long), len(x) // 2))
    curves = []
    for w, k in ((ws, k_short), (wl, k_long)):
        at, parts = _windows(x, max(1, wl // 4), w)
        points = [(med := _median(p)) + k * 1.4826 * (_median(np.abs(p - med)) + 1e-12) for p in parts]
        curves.append(np.interp(np.arange(len(x)), at, points))
    return np.maximum(*curves)


def features_at(frames: DataFrame, marks: DataFrame) -> DataFrame:
    """clip, id, t and the candidate features at any times marks(clip, id, t): those of the frame nearest to t, the first or last one beyond the ends.

    frames: what frame_features gives.
    """
    clips = frames.groupBy("clip").agg(F.max("rate").alias("_rate"), F.max("idx").alias("_last"))
    at = F.bround(F.col("t") * F.col("_rate") / 1e6, 0).cast("long")
    placed = marks.select("clip", "id", "t").join(clips, "clip").select("clip", "id", "t", F.greatest(F.lit(0), F.least(at, F.col("_last"))).alias("idx"))
    peaks = frames.join(placed.select("clip", "idx").distinct(), ["clip", "idx"], "left_semi")
    found = candidate_features(peaks, frames, "before", "after")
    return placed.join(found, ["clip", "idx"])


def onset_strength(audio: DataFrame, stft: Stft = Stft(), low: float = 1000.0, high: float = 6000.0) -> DataFrame:
    """(clip, idx, onset): the rise of log magnitudes in a band from each frame to the next, with zeros up to samples // hop + 1 places."""
    def kernel(clip, sr, x):
        m = kernels.stft(np.asarray(x, float), stft.n_fft, stft.hop)
        freq = np.fft.rfftfreq(stft.n_fft, 1 / sr)
        flux = np.maximum(np.diff(np.log1p(m[:, (freq >= low) & (freq <= high)]), axis=0), 0).sum(1)
        n = len(x) // stft.hop + 1
        return pd.DataFrame({"clip": clip, "idx": np.arange(n), "onset": np.pad(flux, (0, max(0, n - len(flux))))[:n]})

    return _each(kernel, audio, "clip string, idx long, onset double")


#: The columns of the score's features, in the order of a model's weights; the ninth is there only in models of nine.
FEATURES = ("onset_log", "r1_log", "r2_log", "flatness", "attack_norm", "e_low_ratio", "slam", "metal", "mfcc")


def network_at(audio: DataFrame, marks: DataFrame, load, patch=kernels.mel_patch, decode: Callable | None = None) -> DataFrame:
    """(clip, id, network): the probability that a network gives to the patch at every mark (clip, id, t).

    load() returns a function from a batch of patches to probabilities, and is called once for each task.
    """
    listed = marks.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("marks"))

    kind = to_arrow_schema(StructType.fromDDL("clip string, id long, network double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()
        for clip, sr, x, found in _clips(batches):
            x = np.asarray(x if decode is None else decode(x), float)
            p = score(np.stack([patch(x, sr, m["t"] / 1e6) for m in found]))
            yield pa.RecordBatch.from_arrays([pa.array([clip] * len(found), pa.string()), pa.array([m["id"] for m in found], pa.int64()), pa.array(np.asarray(p, float))], schema=kind)

    return audio.join(listed, "clip").select("clip", "sr", "samples", "marks").mapInArrow(run, "clip string, id long, network double")


def shots_improved(audio: DataFrame, model: dict | None = None, features: tuple[str, ...] | None = None, stft: Stft = Stft(), c: Candidates = Candidates(), s: Selection = Selection(), least: float | None = None, network: DataFrame | None = None, network_only: bool = False, extra: DataFrame | None = None, load=None, decode: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(shots, candidates).  Frames to candidate peaks to features to scores, then in this order: gap chains, best of each, hard kill,
    refinement of the times, last-kept de-duplication, rate cap, fusion with the network, confidence gate, rate limit.

    A network comes as load, a function that returns a scorer of patches (see network_at): alone (network_only) it scores the candidates at their frames,
    and is score and confidence at once; else it is fused with the confidence of the shots left, at their refined times.  Or it comes as a table of
    probabilities at the candidates' frames: clip, id (the frame) and network.  extra: clip, id and further feature columns.
    """
    names = features or FEATURES[: len(model["weights"])] if model is not None else ()
    own = "mfcc" in names and (extra is None or "mfcc" not in extra.columns)
    # few rows for each clip, which what follows reads several times
    x = checkpoint(peak_features(audio, stft, c, s, own, decode).drop("threshold", "peak", "before", "after", *["mfcc"] * (extra is not None and "mfcc" in extra.columns)))
    x = x.withColumn("id", F.col("idx")).withColumn("t", F.round(F.col("idx") * 1e6 / F.col("rate")).cast("long"))
    if extra is not None:
        x = x.join(extra, ["clip", "id"], "left")
    if load is not None and network_only:
        network = network_at(audio, x.select("clip", "id", "t"), load, decode=decode)
    if network is not None:
        x = x.join(network.select("clip", "id", "network"), ["clip", "id"], "left")
    alone = network is not None and network_only
    if alone:
        x = x.withColumn("score", F.col("network"))
    elif model is not None:
        x = score.logreg_score(x.withColumn("_f", F.array(*[F.col(f).cast("double") for f in names])), "_f", model).drop("_f")
    else:
        x = x.withColumn("score", F.lit(0.0))
    window: int | Column = micros(s.cluster)
    if s.dynamic:
        low, high = (micros(v) for v in s.dynamic_range)
        windows = metrics.dynamic_window(x.select("clip", "id", "t"), s.dynamic_share, low, high)
        three = x.groupBy("clip").agg(F.count("*").alias("_n"))
        x = x.join(windows, "clip").join(three, "clip").withColumn("_window", F.when(F.col("_n") >= 3, F.col("window")).otherwise(float(window))).drop("window", "_n")
        window = F.col("_window")
    x = dedup.cluster_gap_chain(x, window).drop("_window")
    x = x.withColumn("confidence", F.col("score")) if alone else score.fingerprint_confidence(x, whole=True)
    candidates = x.withColumn("conf", F.col("score"))
    best = F.row_number().over(Window.partitionBy("clip", "cluster").orderBy(F.col("score").desc(), "t", "id"))
    win = candidates.withColumn("_n", best).where("_n = 1").where(~((F.col("attack_norm") < 0.05) & (F.col("e_high_ratio") < 0.08) & (F.col("flatness") < 0.02)))
    # what is reported is rounded first, and the rest decides on what is reported
    at = {"onset": "onset_t", "envelope_peak": "envelope_t", "none": "frame_t"}[s.align]
    win = win.withColumns({"t": F.col(at), "conf": F.round("confidence", 3), "score": F.round("score", 3)})
    along = ("score", *["network"] * (network is not None))
    shots = dedup.dedup_last_kept(win, micros(s.hard_gap), along) if s.hard_gap > 0 else win.select("clip", "id", "t", "conf", *along)
    capped = dedup.rate_cap(shots.withColumn("_keep", F.col("conf")).withColumn("conf", F.col("score")), s.rate).withColumn("conf", F.col("_keep")).drop("_keep")
    if load is not None and not alone:
        capped = capped.join(network_at(audio, capped.select("clip", "id", "t"), load, decode=decode), ["clip", "id"])
    if (network is not None or load is not None) and not alone:
        capped = capped.withColumn("conf", F.round(score.fuse(F.col("conf"), F.col("network"), s.fusion), 3))
    if least is not None:
        capped = capped.where(F.col("conf") >= least)
    return dedup.rate_limit(capped, s.rate, s.hit_rate).select("clip", "id", "t", "conf", "score"), candidates


def _marker(value) -> str:
    value = str(value).strip().lower()
    return value if value in ("onset", "envelope_peak", "none") else "onset"


#: A configuration's keys, the setting of which each is the value, what holds without it, and how it is read.
IMPROVED_KEYS = [
    (Candidates, "mad_k", "mad_k", 7.0, float),
    (Candidates, "candidate_min_dist_ms", "min_distance", 80, lambda ms: float(ms) / 1000),
    (Selection, "cluster_window_sec", "cluster", 0.1, float),
    (Selection, "use_dynamic_cluster", "dynamic", False, bool),
    (Selection, "hard_dedup_gap_sec", "hard_gap", 0.1, lambda gap: max(0.0, float(gap))),
    (Selection, "shot_marker_alignment", "align", "onset", _marker),
    (Selection, "marker_refine_window_sec", "refine", 0.06, lambda width: max(0.01, float(width))),
    (Selection, "cnn_fusion_weight", "fusion", 0.5, float),
]
LEGACY_KEYS = [
    (Legacy, "threshold_coef", "coef", None, None), (Legacy, "threshold_percentile", "percentile", None, None), (Legacy, "min_dist_sec", "min_dist", None, None), (Legacy, "prominence_frac", "prominence", None, None),
    (Legacy, "smooth_ms", "smooth_ms", None, None), (Legacy, "min_confidence", "least", None, None), (Legacy, "post_filter", "post_filter", None, None),
]


def _settings(kind: type, keys: list, config: dict, **more):
    """The settings of one kind under a configuration; a key without a reader sets its value as it is, if it is there."""
    found = {field: read(config.get(key, default)) if read else config[key] for k, key, field, default, read in keys if k is kind and (read or key in config)}
    return kind(**found | more)


def backend(config: dict, loaders: dict, only: bool | None = None) -> tuple[bool, object, object]:
    """(whether the network decides alone, the scorer that then decides, the scorer to fuse with).

    loaders: for "ast" and "cnn" a function from a model's path to its `load` (see network_at); a network counts as loaded if the configuration has a path for it
    and loaders its kind.  Alone, the first kind is taken where the configuration prefers it (by itself, if it has no path of the second), else the second; with
    a network of the wrong kind only, every score is 0, and with none the other scorers decide.  Only the second kind is fused.
    """
    loaded = {kind: loaders[kind](config[f"{kind}_gunshot_path"]) for kind in ("ast", "cnn") if config.get(f"{kind}_gunshot_path") and kind in loaders}
    only = bool(config.get("use_cnn_only", False)) if only is None else only
    first = bool(config.get("use_ast_gunshot", config.get("ast_gunshot_path") and not config.get("cnn_gunshot_path")))
    alone = loaded.get("ast" if first and "ast" in loaded else "cnn") if only else None
    return bool(only and loaded), alone, loaded.get("cnn")


#: Stands for "as the configuration says".
CONFIGURED = object()


def dispatch(audio: DataFrame, config: dict, network: DataFrame | None = None, loaders: dict | None = None, least: object = CONFIGURED, network_only: bool | None = None) -> DataFrame:
    """The shots (clip, id, t, conf) of the detector that a configuration names, under its calibrated values; what it leaves out keeps its default.

    Networks come by loaders (see backend) or as a table of probabilities; least and network_only, where given, stand above the configuration (least may be None: no gate).
    """
    if not config.get("use_improved", True):
        return legacy_shots(audio, _settings(Legacy, LEGACY_KEYS, config))
    share = config.get("threshold_percentile")
    c = _settings(Candidates, IMPROVED_KEYS, config, threshold=float(share) if share is not None else "multi" if config.get("use_multi_scale_threshold") else "mad")
    s = _settings(Selection, IMPROVED_KEYS, config)
    least = config.get("min_confidence_threshold", config.get("min_score_threshold")) if least is CONFIGURED else least
    decides, alone, fused = backend(config, loaders or {}, network_only)
    model = config.get("logreg_model")
    if network is not None:
        only = bool(config.get("use_cnn_only", False)) if network_only is None else network_only
        shots, _ = shots_improved(audio, model, c=c, s=s, least=least, network=network, network_only=only)
    elif decides and alone is not None:
        shots, _ = shots_improved(audio, model, c=c, s=s, least=least, load=alone, network_only=True)
    else:
        shots, _ = shots_improved(audio, None if decides else model, c=c, s=s, least=least, load=fused)
    return shots.select("clip", "id", "t", "conf")
