"""Series and kernel queries: a user's values in time order are a frame series, embeddings are spectra."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import detect, kernels, signal
from tidemark.shared import checkpoint
from tidemark.plans.bind import BEEP, CAND, DET, EV, FRAMES, HOUR, REF, SERIES, frames, read, role, rounded, timeline

QUERIES, SQL = {}, {}
S = f"{EV}, {SERIES}"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _s(spark, d) -> DataFrame:
    return signal.as_series(timeline(spark, d))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _average(k: int):
    def run(spark, d):
        return _rounded(signal.moving_average(_s(spark, d), k).select("clip", "idx", "smooth"), "smooth")

    a, b = ((k - 1) // 2, (k - 1) // 2) if k % 2 else (k // 2, k // 2 - 1)
    return run, f"WITH {S} SELECT clip, idx, round(sum(value) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING) / {k}, 6) AS smooth FROM s"


QUERIES["moving_average_odd"], SQL["moving_average_odd"] = _average(5)
QUERIES["moving_average_even"], SQL["moving_average_even"] = _average(4)


@query
def local_envelope(spark, d):
    return signal.envelope(_s(spark, d), 5).select("clip", "idx", "upper", "lower")


SQL["local_envelope"] = f"WITH {S} SELECT clip, idx, max(value) OVER w AS upper, min(value) OVER w AS lower FROM s WINDOW w AS (PARTITION BY clip ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query
def normalize_max(spark, d):
    return _rounded(signal.normalize_max(_s(spark, d)).select("clip", "idx", "norm"), "norm")


SQL["normalize_max"] = f"WITH {S} SELECT clip, idx, round(value / max(value) OVER (PARTITION BY clip), 6) AS norm FROM s"


@query
def percentile_threshold(spark, d):
    return _rounded(signal.percentile_threshold(_s(spark, d), 0.92), "threshold")


SQL["percentile_threshold"] = f"WITH {S} SELECT clip, round(quantile_cont(value, 0.92), 6) AS threshold FROM s GROUP BY clip"


@query
def mad_threshold(spark, d):
    return _rounded(signal.mad_threshold(_s(spark, d), 20.0, 2.0, 3.14159265).select("clip", "idx", "threshold"), "threshold")


def _points(name: str, w: str, step: str, dev: str, k: float) -> str:
    return f"""{name}x AS (SELECT clip, n, {w} AS w, {step} AS st FROM n), {name}a AS (SELECT clip, w, st, unnest(range(0, n, st)) AS pos FROM {name}x),
{name}v AS (SELECT a.clip, a.pos, s.value AS v FROM {name}a a JOIN s ON s.clip = a.clip AND s.idx >= a.pos - a.w // 2 AND s.idx < a.pos + a.w // 2), {name}m AS (SELECT clip, pos, quantile_cont(v, 0.5) AS med, stddev_pop(v) AS sd FROM {name}v GROUP BY 1, 2),
{name}d AS (SELECT m.clip, m.pos, quantile_cont(abs(v - med), 0.5) AS mad FROM {name}v v JOIN {name}m m ON m.clip = v.clip AND m.pos = v.pos GROUP BY 1, 2), {name} AS (SELECT m.clip, m.pos, med + {k} * ({dev}) AS th FROM {name}m m JOIN {name}d d ON d.clip = m.clip AND d.pos = m.pos)"""


def _lerp(p: str) -> str:
    return f"(SELECT s.clip, s.idx, CASE WHEN b.th IS NULL THEN a.th WHEN a.pos = b.pos THEN a.th ELSE a.th + (b.th - a.th) / (b.pos - a.pos) * (s.idx - a.pos) END AS th FROM s ASOF JOIN {p} a ON a.clip = s.clip AND s.idx >= a.pos ASOF LEFT JOIN {p} b ON b.clip = s.clip AND s.idx <= b.pos)"


_N = f"{S}, n AS (SELECT clip, count(*) AS n FROM s GROUP BY clip)"
SQL["mad_threshold"] = f"WITH {_N}, {_points('p', 'greatest(10, least(40, n // 4))', 'greatest(1, greatest(10, least(40, n // 4)) // 4)', 'CASE WHEN mad > 0 THEN mad * 1.4826 ELSE sd END', 3.14159265)} SELECT clip, idx, round(th, 6) AS threshold FROM {_lerp('p')}"


@query
def mad_threshold_multi(spark, d):
    return _rounded(signal.mad_threshold_multi(_s(spark, d), 20.0).select("clip", "idx", "threshold"), "threshold", digits=5)


_WS, _WL = "greatest(10, least(10, n // 4))", "greatest(greatest(10, least(10, n // 4)), least(60, n // 2))"
_D = "(mad + 1e-12) * 1.4826"
SQL["mad_threshold_multi"] = f"WITH {_N}, {_points('p', _WS, f'greatest(1, {_WL} // 4)', _D, 4.0)}, {_points('q', _WL, f'greatest(1, {_WL} // 4)', _D, 2.5)} SELECT x.clip, x.idx, round(greatest(x.th, y.th), 5) AS threshold FROM {_lerp('p')} x JOIN {_lerp('q')} y ON y.clip = x.clip AND y.idx = x.idx"


def _plateaus(spark, d):
    return _s(spark, d).withColumn("value", F.floor(F.col("value") / 40))


@query
def local_maxima(spark, d):
    return signal.local_maxima(_plateaus(spark, d)).select("clip", "idx", F.col("value").cast("long").alias("value"))


SQL["local_maxima"] = f"""WITH {S}, x AS (SELECT clip, idx, CAST(floor(value / 40) AS BIGINT) AS v FROM s), y AS (SELECT *, CASE WHEN v <> lag(v) OVER (PARTITION BY clip ORDER BY idx) THEN 1 ELSE 0 END AS b FROM x), z AS (SELECT *, sum(b) OVER (PARTITION BY clip ORDER BY idx) AS g FROM y),
r AS (SELECT clip, g, min(idx) AS lo, max(idx) AS hi, min(v) AS v FROM z GROUP BY 1, 2), q AS (SELECT *, lag(v) OVER (PARTITION BY clip ORDER BY g) AS a, lead(v) OVER (PARTITION BY clip ORDER BY g) AS c FROM r) SELECT clip, (lo + hi) // 2 AS idx, v AS value FROM q WHERE a < v AND c < v"""


@query
def spectral_flux(spark, d):
    return _rounded(signal.spectral_flux(frames(spark, d), 2, 50), "flux")


SQL["spectral_flux"] = f"WITH {FRAMES}, x AS (SELECT clip, idx, list_transform(mag[3:50], lambda v: ln(1 + v)) AS l FROM f), y AS (SELECT clip, idx, l, lag(l) OVER (PARTITION BY clip ORDER BY idx) AS p FROM x) SELECT clip, idx, round(CASE WHEN p IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 49), lambda i: greatest(l[i] - p[i], 0))) END, 6) AS flux FROM y"


@query
def band_energy(spark, d):
    out = signal.band_energy(frames(spark, d), [(0, 10), (10, 30), (30, 64)], ["e_low", "e_mid", "e_high"])
    return _rounded(out.select("clip", "idx", "e_low", "e_mid", "e_high"), "e_low", "e_mid", "e_high")


SQL["band_energy"] = f"WITH {FRAMES} SELECT clip, idx, " + ", ".join(f"round(list_sum(list_transform(mag[{a + 1}:{b}], lambda v: v * v)), 6) AS {n}" for a, b, n in ((0, 10, "e_low"), (10, 30, "e_mid"), (30, 64, "e_high"))) + " FROM f"


@query
def spectral_shape(spark, d):
    return _rounded(signal.spectral_shape(frames(spark, d)).select("clip", "idx", "centroid", "flatness"), "centroid", "flatness")


SQL["spectral_shape"] = f"WITH {FRAMES} SELECT clip, idx, round(list_sum(list_transform(range(64), lambda i: i * mag[i + 1] * mag[i + 1])) / list_sum(list_transform(mag, lambda v: v * v)), 6) AS centroid, round(exp(list_avg(list_transform(list_filter(mag, lambda v: v > 1e-9), lambda v: ln(v)))) / (list_avg(mag) + 1e-9), 6) AS flatness FROM f"


@query
def attack_slope(spark, d):
    return _rounded(signal.attack_slope(_s(spark, d), 4, 10.0).select("clip", "idx", "attack"), "attack")


SQL["attack_slope"] = f"WITH {S}, x AS (SELECT *, value - lag(value) OVER (PARTITION BY clip ORDER BY idx) AS r FROM s) SELECT clip, idx, round(CASE WHEN idx >= 4 THEN max(r) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 0.4 ELSE 0 END, 6) AS attack FROM x"


@query
def attack_by_frame(spark, d):
    return _rounded(signal.attack_by_frame(signal.attack_slope(_s(spark, d), 4, 10.0), 8), "attack")


SQL["attack_by_frame"] = f"WITH a AS ({SQL['attack_slope']}) SELECT clip, idx // 8 AS idx, max(attack) AS attack FROM a GROUP BY 1, 2"


def _marks(spark, d):
    s = signal.as_series(timeline(spark, d))
    return s.join(timeline(spark, d, DET).select("clip", "id"), ["clip", "id"], "left_semi").select("clip", "id", F.col("idx").alias("at")), s.select("clip", "idx", "value")


@query
def refine_onset(spark, d):
    marks, s = _marks(spark, d)
    return signal.refine_onset(marks, s, 4, 0.5)


_MARK = f"{S}, {role('d', DET)}, m AS (SELECT s.clip, s.id, s.idx AS pos FROM s JOIN d ON d.clip = s.clip AND d.id = s.id), p AS (SELECT m.clip, m.id, m.pos, s.idx, s.value AS v FROM m JOIN s ON s.clip = m.clip AND s.idx >= m.pos - 4 AND s.idx < m.pos + 4)"
SQL["refine_onset"] = f"""WITH {_MARK}, q AS (SELECT *, max(v) OVER (PARTITION BY clip, id) AS top, count(*) OVER (PARTITION BY clip, id) AS n FROM p) SELECT clip, id, pos AS "at", coalesce(min(idx) FILTER (WHERE n >= 4 AND v >= 0.5 * (top + 1e-12)), pos) AS refined FROM q GROUP BY clip, id, pos"""


@query
def refine_slope(spark, d):
    marks, s = _marks(spark, d)
    return signal.refine_onset(marks, s, 4, 0.0)


SQL["refine_slope"] = f"""WITH {_MARK}, q AS (SELECT *, lead(v) OVER (PARTITION BY clip, id ORDER BY idx) - v AS r, count(*) OVER (PARTITION BY clip, id) AS n FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY clip, id ORDER BY r DESC, idx) AS k FROM q WHERE r IS NOT NULL AND n >= 4) SELECT m.clip, m.id, m.pos AS "at", coalesce(b.idx, m.pos) AS refined FROM m LEFT JOIN b ON b.clip = m.clip AND b.id = m.id AND k = 1"""


@query
def refine_peak(spark, d):
    marks, s = _marks(spark, d)
    return signal.refine_peak(marks, s, 4)


SQL["refine_peak"] = f"""WITH {_MARK} SELECT clip, id, pos AS "at", CASE WHEN n >= 2 THEN idx ELSE pos END AS refined FROM (SELECT *, row_number() OVER (PARTITION BY clip, id ORDER BY v DESC, idx) AS k, count(*) OVER (PARTITION BY clip, id) AS n FROM p) WHERE k = 1"""


@query
def frame_difference(spark, d):
    return _rounded(signal.frame_difference(frames(spark, d)), "motion", digits=8)


SQL["frame_difference"] = f"WITH {FRAMES}, x AS (SELECT clip, idx, mag, lag(mag) OVER (PARTITION BY clip ORDER BY idx) AS p FROM f) SELECT clip, idx, round(list_sum(list_transform(range(1, 65), lambda i: abs(mag[i] - p[i]))) / (64 * 255.0), 8) AS motion FROM x WHERE p IS NOT NULL"


@query
def multi_frame_difference(spark, d):
    return _rounded(signal.multi_frame_difference(frames(spark, d), 4), "motion", digits=8)


SQL["multi_frame_difference"] = f"""WITH {FRAMES}, x AS (SELECT clip, idx, mag, lag(mag) OVER (PARTITION BY clip ORDER BY idx) AS p FROM f), m AS (SELECT clip, idx, list_sum(list_transform(range(1, 65), lambda i: abs(mag[i] - p[i]))) / (64 * 255.0) AS v FROM x WHERE p IS NOT NULL),
l AS (SELECT *, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b FROM m WINDOW w AS (PARTITION BY clip ORDER BY idx)) SELECT clip, idx, round((coalesce(b * 0.3, 0) + coalesce(a * 0.65, 0) + v) / (CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN a IS NULL THEN 0 ELSE 0.65 END + 1.0), 8) AS motion FROM l"""


@query
def resample_linear(spark, d):
    return _rounded(signal.resample(_s(spark, d).select("clip", "idx", "value"), 34), "value", digits=5)


SQL["resample_linear"] = f"WITH {S}, n AS (SELECT clip, max(idx) AS m FROM s GROUP BY clip), k AS (SELECT clip, k, k * m / 33.0::DOUBLE AS p FROM n, (SELECT unnest(range(34)) AS k)) SELECT k.clip, k AS idx, round(a.value + (p - floor(p)) * coalesce(b.value - a.value, 0), 5) AS value FROM k JOIN s a ON a.clip = k.clip AND a.idx = CAST(floor(p) AS BIGINT) LEFT JOIN s b ON b.clip = k.clip AND b.idx = a.idx + 1"


@query
def decimate(spark, d):
    return signal.decimate(_s(spark, d), 20).select("clip", "idx", "value")


SQL["decimate"] = f"WITH {S}, n AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY clip) // 20) AS st FROM s) SELECT clip, idx, value FROM n WHERE idx % st = 0"


@query
def candidate_features(spark, d):
    f = signal.spectral_shape(signal.band_energy(frames(spark, d), [(0, 10), (10, 30), (30, 64)], ["e_low", "e_mid", "e_high"])).withColumn("attack", F.col("mag")[0])
    p = f.select("clip", "idx", F.col("mag")[1].alias("onset"))
    out = signal.candidate_features(p, f, 2, 3)
    names = ["r1", "r2", "r1_log", "r2_log", "flatness", "attack_norm", "onset_log", "e_low_ratio", "e_high_ratio", "r1_penalty"]
    return _rounded(out.select("clip", "idx", *names, "slam", "metal"), *names, digits=5)


SQL["candidate_features"] = f"""WITH {FRAMES}, x AS (SELECT clip, idx, mag, mag[1] AS attack, list_sum(list_transform(mag[1:10], lambda v: v * v)) AS el, list_sum(list_transform(mag[11:30], lambda v: v * v)) AS em, list_sum(list_transform(mag[31:64], lambda v: v * v)) AS eh, exp(list_avg(list_transform(list_filter(mag, lambda v: v > 1e-9), lambda v: ln(v)))) / (list_avg(mag) + 1e-9) AS fl FROM f),
rf AS (SELECT clip, quantile_cont(attack, 0.995) AS ref FROM x GROUP BY clip), g AS (SELECT p.clip, p.idx, p.mag[2] AS onset, avg(x.el) AS l, avg(x.em) AS m, avg(x.eh) AS h, avg(x.fl) AS flat, max(x.attack) AS att FROM x p JOIN x ON x.clip = p.clip AND x.idx BETWEEN p.idx - 2 AND p.idx + 3 GROUP BY 1, 2, 3),
y AS (SELECT g.*, m / (l + 1e-9) AS r1, h / (m + 1e-9) AS r2, ln(m + 1e-9) - ln(l + 1e-9) AS r1l, ln(h + 1e-9) - ln(m + 1e-9) AS r2l, least(att / (ref + 1e-9), 1.0) AS an, l / (l + m + h + 1e-9) AS lr FROM g JOIN rf ON rf.clip = g.clip)
SELECT clip, idx, round(r1, 5) AS r1, round(r2, 5) AS r2, round(r1l, 5) AS r1_log, round(r2l, 5) AS r2_log, round(flat, 5) AS flatness, round(an, 5) AS attack_norm, round(ln(1 + onset), 5) AS onset_log, round(lr, 5) AS e_low_ratio, round(r1 * r2 / (1 + r1 + r1 * r2 + 1e-9), 5) AS e_high_ratio, round(greatest(0, 0.7 - r1l), 5) AS r1_penalty, lr > 0.65 OR (lr > 0.55 AND flat < 0.22) AS slam, r2l > 1.2 AND flat > 0.5 AND an < 0.4 AS metal FROM y"""


@query
def strong_peaks(spark, d):
    """Values of at least 0.55 of the clip's greatest."""
    top = signal.normalize_max(_s(spark, d))
    return top.where("norm >= 0.55").select("clip", "idx", "value")


SQL["strong_peaks"] = f"WITH {S}, x AS (SELECT *, max(value) OVER (PARTITION BY clip) AS top FROM s) SELECT clip, idx, value FROM x WHERE value / top >= 0.55"


@query
def isolated_peaks(spark, d):
    """Rows without another in the two hours before; all rows of a clip that has none such."""
    from pyspark.sql import Window

    t = timeline(spark, d)
    near = F.count("*").over(Window.partitionBy("clip").orderBy("t").rangeBetween(-2 * HOUR, -1))
    x = t.withColumn("_alone", near == 0)
    some = F.max("_alone").over(Window.partitionBy("clip"))
    return x.withColumn("_some", some).where("_alone or not _some").select("clip", "id")


SQL["isolated_peaks"] = f"WITH {EV}, x AS (SELECT clip, id, count(*) OVER (PARTITION BY clip ORDER BY t RANGE BETWEEN {2 * HOUR} PRECEDING AND 1 PRECEDING) = 0 AS alone FROM ev), y AS (SELECT *, bool_or(alone) OVER (PARTITION BY clip) AS has FROM x) SELECT clip, id FROM y WHERE alone OR NOT has"


@query
def after_beep(spark, d):
    b = timeline(spark, d, BEEP).groupBy("clip").agg(F.min("t").alias("t0"))
    return timeline(spark, d, DET).join(b, "clip").where("t >= t0").select("clip", "id", (F.col("t") - F.col("t0")).alias("since"))


SQL["after_beep"] = f"WITH {EV}, {role('d', DET)}, b AS (SELECT clip, min(t) AS t0 FROM ev WHERE kind = '{BEEP}' GROUP BY clip) SELECT d.clip, d.id, t - t0 AS since FROM d JOIN b ON b.clip = d.clip WHERE t >= t0"


@query
def confidence_gate(spark, d):
    return timeline(spark, d, DET).where(F.col("conf") >= 45.0).select("clip", "id", "conf")


SQL["confidence_gate"] = f"WITH {EV}, {role('d', DET)} SELECT clip, id, conf FROM d WHERE conf >= 45"

# Kernels: a user's values are samples at 1000 a second, and so are the places of the events among them.
RATE = 1000.0


def _dealt(spark, e: DataFrame, least: int = 1) -> DataFrame:
    """Events by clip, dealt to all tasks, `least` or more: what is made of a clip is far more work than its events' bytes tell."""
    return e.repartition(max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))), "clip")


def _audio(spark, d) -> DataFrame:
    e = timeline(spark, d).select(F.col("clip").cast("string").alias("clip"), F.struct("t", "id", "conf").alias("x"))
    rows = _dealt(spark, e).groupBy("clip").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("clip", F.lit(RATE).alias("sr"), F.transform("x", lambda r: r["conf"]).alias("samples"))


def _places(spark, d, kind, rate=RATE) -> DataFrame:
    """(clip, id, t): the events of a kind, t their place among the clip's samples in microseconds."""
    s = signal.as_series(timeline(spark, d))
    at = s.join(timeline(spark, d, kind).select("clip", "id"), ["clip", "id"], "left_semi")
    return at.select(F.col("clip").cast("string").alias("clip"), "id", (F.col("idx") * int(1e6 / rate)).alias("t"))


def _small():
    from tidemark.params import Stft

    return Stft(n_fft=16, hop=4, low_hz=80, high_hz=400, bands=((50, 150), (150, 300), (300, 450)))


@query
def stft_frames(spark, d):
    f = detect.stft_frames(_audio(spark, d), _small())
    return f.select("clip", "idx", F.posexplode("mag").alias("bin", "mag")).select("clip", "idx", "bin", rounded("mag", 5).alias("mag"))


_SIN = "list_sum(list_transform(range(16), lambda i: coalesce(xs[idx * 4 + i + 1], 0) * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * {f}(2 * pi() * i * bin / 16)))"
_STFT = f"{EV}, g AS (SELECT clip, list(conf ORDER BY t, id) AS xs, count(*) AS n FROM ev GROUP BY clip), k AS (SELECT *, unnest(range(greatest(1, (n - 16) // 4 + 1))) AS idx FROM g), b AS (SELECT *, unnest(range(9)) AS bin FROM k), st AS (SELECT clip, n, idx, bin, sqrt(pow({_SIN.format(f='cos')}, 2) + pow({_SIN.format(f='sin')}, 2)) AS mag FROM b)"
SQL["stft_frames"] = f"WITH {_STFT} SELECT CAST(clip AS VARCHAR) AS clip, idx, CAST(bin AS INT) AS bin, round(mag, 5) AS mag FROM st"


@query
def onset_strength(spark, d):
    out = detect.onset_strength(_audio(spark, d), _small(), 100.0, 350.0)
    return out.select("clip", "idx", rounded("onset", 5).alias("onset"))


SQL["onset_strength"] = f"""WITH {_STFT}, r AS (SELECT clip, n, idx, lead(ln(1 + mag)) OVER (PARTITION BY clip, bin ORDER BY idx) - ln(1 + mag) AS up FROM st WHERE bin * 62.5 BETWEEN 100 AND 350),
f AS (SELECT clip, idx, sum(greatest(up, 0)) AS flux FROM r GROUP BY clip, idx), p AS (SELECT clip, unnest(range(n // 4 + 1)) AS idx FROM g)
SELECT CAST(p.clip AS VARCHAR) AS clip, p.idx, round(coalesce(f.flux, 0)::DOUBLE, 5) AS onset FROM p LEFT JOIN f ON f.clip = p.clip AND f.idx = p.idx"""


@query
def bandpass_energy(spark, d):
    """Rows only: a recursive filter; tests compare it with the plain recurrence."""
    from tidemark.params import Energy

    return detect.energy_shots(_audio(spark, d), Energy(low_hz=50, high_hz=200, threshold=0.2, min_distance=0.004, smooth=0.003))


@query
def dominant_freq(spark, d):
    """Rows only: transforms of 2048 points, from every detection on; tests use sine waves."""
    return detect.dominant_frequencies(_audio(spark, d), _places(spark, d, DET), 0.06)


@query
def mel_patch(spark, d):
    """Rows only: one pooled number for each detection's patch; tests check shape and padding."""
    p = detect.mel_patches(_audio(spark, d), _places(spark, d, DET), before=0.02, after=0.02, n_mels=16)
    total = F.aggregate(F.flatten("patch"), F.lit(0.0), lambda s, v: s + v)
    return p.select("clip", "id", "t", F.size("patch").alias("bands"), F.size(F.col("patch")[0]).alias("frames"), (total / F.size(F.flatten("patch"))).alias("mean"))


@query
def mel_training_set(spark, d):
    """Rows only, as mel_patch: the candidates from the first beep on, with their labels and patches."""
    p = detect.mel_training_set(_audio(spark, d), _places(spark, d, CAND), _places(spark, d, REF), _places(spark, d, BEEP), 20000, 20000, before=0.02, after=0.02, n_mels=16)
    return p.select("clip", "id", "t", "label", F.transform(F.flatten("patch"), lambda v: rounded(v, 4)).alias("patch"))


@query
def mfcc_band(spark, d):
    """Rows only, as mel_patch."""
    return detect.at_marks(_audio(spark, d), _places(spark, d, DET), lambda x, sr, t: (kernels.mfcc_band(x, sr, t),), "band double")


@query
def second_recovery(spark, d):
    """Rows only: peaks above the adaptive threshold and those recovered behind them; tests use a plain loop."""
    def kernel(clip, sr, x):
        import pandas as pd

        x = np.asarray(x, float)
        limit = detect.mad_curve(x, 20.0, 2.0, 1.0)
        at = kernels.find_peaks(x, distance=3)
        at = at[x[at] >= limit[at]]
        all_ = kernels.recover_second(x, limit, at, 0.5, 2, 10, 3)
        return pd.DataFrame({"clip": clip, "idx": all_, "recovered": ~np.isin(all_, at)})

    return detect._each(kernel, _audio(spark, d), "clip string, idx long, recovered boolean")


def _legacy():
    from tidemark.params import Legacy

    return Legacy(coef=0.5, min_dist=0.003, prominence=0.1, smooth_ms=2.0, band=(50.0, 200.0))


@query
def legacy_detector(spark, d):
    """Rows only: the composite detector; tests compare it with plain loops."""
    return detect.legacy_shots(_audio(spark, d), _legacy())


@query
def calibrate_legacy(spark, d):
    """Rows only: the calibration search over its 162 settings, with shorter times and a lower band, as the clips are short and slow."""
    from dataclasses import replace

    from tidemark.operators.search import calibrate, calibration_grid

    grid = [replace(p, min_dist=p.min_dist / 25, smooth_ms=p.smooth_ms / 3, band=(50.0, 200.0)) for p in calibration_grid()]
    return calibrate(_audio(spark, d), _places(spark, d, REF), 4000, grid)


@query
def motion_detector(spark, d):
    """Rows only: the composite detector on value series at 20 frames a second."""
    s = _audio(spark, d).select("clip", F.lit(20.0).alias("fps"), F.col("samples").alias("values"), F.lit(None).cast("array<double>").alias("directions"))
    return detect.motion_peaks(s)


@query
def motion_learned(spark, d):
    """Rows only: threshold learned at the clip's references."""
    refs = _places(spark, d, REF, 20.0).groupBy("clip").agg(F.array_sort(F.collect_list(F.col("t") / 1e6)).alias("refs"))
    s = _audio(spark, d).join(refs, "clip", "left").select("clip", F.lit(20.0).alias("fps"), F.col("samples").alias("values"), "refs")
    return detect.motion_learned(s)


#: Sounds made of a user's events: one every STEP seconds, at SOUND samples a second.
SOUND, STEP = 16000.0, 0.08


def _sound(events) -> np.ndarray:
    """A clip's sound: detections are bursts of noise as loud as their values that die away, beeps are tones of 3 kHz, the rest is faint noise.
    The noise of an event comes from its id, so that every run hears the same."""
    step = int(SOUND * STEP)
    y = np.zeros(len(events) * step + int(0.6 * SOUND))
    tone, fade = _shapes()
    faint, burst = np.empty(step), np.empty(len(fade))
    for i, (e, r) in enumerate(zip(events, kernels.generators([e["id"] for e in events]))):
        a = i * step
        r.standard_normal(out=faint)
        np.multiply(faint, 0.001, out=faint)
        y[a : a + step] += faint
        if e["kind"] == BEEP:
            y[a : a + len(tone)] += tone
        elif e["kind"] == DET:
            r.standard_normal(out=burst)
            np.multiply(burst, 0.5, out=burst)
            burst *= e["conf"] / 200
            burst *= fade
            y[a : a + len(fade)] += burst
    return y


@lru_cache(maxsize=1)
def _shapes() -> tuple[np.ndarray, np.ndarray]:
    """The tone of a beep, and how a detection's noise dies away."""
    return 0.4 * np.sin(2 * np.pi * 3000 * np.arange(int(0.3 * SOUND)) / SOUND), np.exp(-np.arange(int(0.1 * SOUND)) / (0.012 * SOUND))


def _sounds(spark, d, least: int = 1) -> DataFrame:
    """(clip, sr, samples): a clip's events in order, of which _sound makes its samples; in so many tasks at least."""
    e = read(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    event = F.struct(at.alias("t"), F.col("event_id").alias("id"), F.col("value").alias("conf"), F.col("event_type").alias("kind"))
    rows = _dealt(spark, e.select(F.col("user_id").cast("string").alias("clip"), event.alias("x")), least)
    return rows.groupBy("clip").agg(F.array_sort(F.collect_list("x")).alias("samples")).select("clip", F.lit(SOUND).alias("sr"), "samples")


def _heard(spark, d, kind) -> DataFrame:
    """(clip, id, t): where the events of a kind begin in their clip's sound."""
    s = signal.as_series(timeline(spark, d))
    at = s.join(timeline(spark, d, kind).select("clip", "id"), ["clip", "id"], "left_semi")
    return at.select(F.col("clip").cast("string").alias("clip"), "id", (F.col("idx") * int(STEP * 1e6)).alias("t"))


@query
def beep_detector(spark, d):
    """Rows only: the composite detector on sounds of tones and bursts; tests work cases by hand."""
    return detect.beeps(_sounds(spark, d), decode=_sound)


@query
def all_beeps(spark, d):
    """Rows only, as beep_detector: every beep of each clip."""
    return detect.beeps(_sounds(spark, d), first_only=False, decode=_sound)


@query
def tune_beeps(spark, d):
    """Rows only: the beep search over its 24 settings."""
    from tidemark.operators.search import tune_beeps as tune

    truth = _heard(spark, d, BEEP).groupBy("clip").agg(F.min("t").alias("t"))
    return tune(_sounds(spark, d), truth, decode=_sound)


@query
def improved_detector(spark, d):
    """Rows only: frames to shots in one composition, on sounds of tones and bursts, with a model of nine weights; tests compare it with plain loops."""
    model = {"weights": [0.9, 0.2, -0.1, 0.4, 1.2, -0.6, -0.3, -0.4, 0.2], "bias": -0.3, "mean": [2.0, 1.0, -1.0, 0.4, 0.4, 0.2, 0.1, 0.1, 6.0], "std": [1.0, 1.5, 1.0, 0.2, 0.3, 0.2, 1.0, 0.3, 3.0]}
    # a task's clips take minutes in large tables: in some tasks for each core, so that none waits long for the last ones
    sounds = _sounds(spark, d, 4 * spark.sparkContext.defaultParallelism)
    shots, _ = detect.shots_improved(sounds, model, least=0.3, decode=_sound)
    return shots.select("clip", "id", "t", rounded("conf", 6).alias("conf"))


@query
def features_at_times(spark, d):
    """Rows only: the candidate features at every reference."""
    frames = checkpoint(detect.frame_features(_audio(spark, d), _small()))  # read four times
    out = detect.features_at(frames, _places(spark, d, REF))
    return out.select("clip", "id", "t", "idx", *[rounded(c, 5).alias(c) for c in ("onset_log", "r1_log", "r2_log", "flatness", "attack_norm", "e_low_ratio")], "slam", "metal")


@query
def detector_dispatch(spark, d):
    """Rows only: the detector that a configuration names."""
    config = {"use_improved": False, "threshold_coef": 0.5, "min_dist_sec": 0.0005, "prominence_frac": 0.1, "smooth_ms": 0.5}
    return detect.dispatch(_audio(spark, d).withColumn("sr", F.lit(8000.0)), config).select("clip", "id", "t", "conf")
