"""Series operators in native expressions.

A series is a (clip, idx, value) table, idx from 0 without gaps; a spectrogram is (clip, idx, mag) with mag an array.
All of them partition by clip, so a chain of them needs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_clip():
    return Window.partitionBy("clip").orderBy("idx")


def as_series(df: DataFrame, value: str = "conf") -> DataFrame:
    """Timed rows as a series, in order of (t, id)."""
    n = F.row_number().over(Window.partitionBy("clip").orderBy("t", "id")) - 1
    return df.select("clip", n.cast("long").alias("idx"), F.col(value).alias("value"), "t", "id")


def moving_average(s: DataFrame, k: int, value: str = "value", name: str = "smooth") -> DataFrame:
    """Zero-padded moving average of k samples: the window's sum over k, also at the edges."""
    before, after = ((k - 1) // 2, (k - 1) // 2) if k % 2 else (k // 2, k // 2 - 1)
    return s.withColumn(name, F.sum(value).over(by_clip().rowsBetween(-before, after)) / k)


def envelope(s: DataFrame, width: int, value: str = "value") -> DataFrame:
    """Adds upper and lower: greatest and least of `width` samples around (one more before than after if even)."""
    w = by_clip().rowsBetween(-(width // 2), width - 1 - width // 2)
    return s.withColumn("upper", F.max(value).over(w)).withColumn("lower", F.min(value).over(w))


def normalize_max(s: DataFrame, value: str = "value", name: str = "norm") -> DataFrame:
    """Divided by the clip's maximum if that is above 0."""
    top = F.max(value).over(Window.partitionBy("clip"))
    return s.withColumn("_top", top).withColumn(name, F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def percentile_threshold(s: DataFrame, q: float, value: str = "value") -> DataFrame:
    """(clip, threshold): the percentile with linear interpolation."""
    return s.groupBy("clip").agg(F.expr(f"percentile({value}, {q})").alias("threshold"))


def _points(s: DataFrame, value: str, window: Column, step: Column, name: str, mad: Column) -> DataFrame:
    """(clip, at, med, dev) at every multiple of step: median and deviation of [at - window // 2, at + window // 2).

    A sample is dealt to the points whose window it is in - at most window / step + 1 of them - so a point's window is one small group.
    """
    n = F.count("*").over(Window.partitionBy("clip"))
    x = s.select("clip", "idx", F.col(value).alias("v"), n.alias("_n")).withColumn("_w", window).withColumn("_s", step).withColumn("_h", F.floor(F.col("_w") / 2))
    # at - h <= idx < at + h, at = s m, 0 <= at < n
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("idx") - F.col("_h")) / F.col("_s")) + 1)
    high = F.least(F.floor((F.col("_n") - 1) / F.col("_s")), F.floor((F.col("idx") + F.col("_h")) / F.col("_s")))
    dealt = x.where(high >= low).select("clip", "_s", "_n", "v", F.explode(F.sequence(low, high)).alias("m"))
    g = dealt.groupBy("clip", "m", "_s", "_n").agg(F.array_sort(F.collect_list("v")).alias("_xs"), F.stddev_pop("v").alias("_std"))
    g = g.withColumn("med", _middle(F.col("_xs")))
    g = g.withColumn("_devs", F.array_sort(F.transform("_xs", lambda x: F.abs(x - F.col("med"))))).withColumn("_mad", _middle(F.col("_devs")))
    return g.select("clip", (F.col("m") * F.col("_s")).alias("at"), "med", mad.alias(name))


def _middle(xs: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(xs)
    return (F.get(xs, F.floor((n - 1) / 2).cast("int")) + F.get(xs, F.floor(n / 2).cast("int"))) / 2


def interpolate(s: DataFrame, points: DataFrame, names: list[str]) -> DataFrame:
    """Adds names, linear between the points (clip, at, names...) and flat outside them."""
    p = points.withColumnRenamed("at", "idx")
    x = s.join(p, ["clip", "idx"], "left")
    at = F.when(F.col(names[0]).isNotNull(), F.struct("idx", *names))
    back = F.last(at, ignorenulls=True).over(by_clip().rowsBetween(Window.unboundedPreceding, 0))
    r = Window.partitionBy("clip").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_a", back).withColumn("_b", F.last(at, ignorenulls=True).over(r)).drop(*names)
    for n in names:
        a, b = F.col(f"_a.{n}"), F.col(f"_b.{n}")
        slope = (b - a) / (F.col("_b.idx") - F.col("_a.idx"))
        between = F.when(F.col("_b.idx") == F.col("_a.idx"), a).otherwise(a + slope * (F.col("idx") - F.col("_a.idx")))
        x = x.withColumn(n, F.when(F.col("_a").isNull(), b).when(F.col("_b").isNull(), a).otherwise(between))
    return x.drop("_a", "_b")


def mad_threshold(s: DataFrame, rate: float, window: float = 2.0, k: float = 6.0, value: str = "value") -> DataFrame:
    """Adds threshold: median + k deviations of a sliding window, taken every quarter window and interpolated.

    The window has rate x window samples, at least 10, at most a quarter of the series (but then at least 10).  The
    deviation is 1.4826 MAD, or the standard deviation where the MAD is 0.
    """
    w = F.greatest(F.lit(10), F.least(F.lit(int(rate * window)), F.floor(F.col("_n") / 4)))
    step = F.greatest(F.lit(1), F.floor(F.col("_w") / 4))
    dev = F.when(F.col("_mad") > 0, F.col("_mad") * 1.4826).otherwise(F.col("_std"))
    p = _points(s, value, w, step, "dev", dev).select("clip", "at", (F.col("med") + k * F.col("dev")).alias("threshold"))
    return interpolate(s, p, ["threshold"])


def mad_threshold_multi(s: DataFrame, rate: float, short: float = 0.5, long: float = 3.0, k_short: float = 4.0, k_long: float = 2.5, value: str = "value") -> DataFrame:
    """Adds threshold: the greater of a short and a long window's, both taken every quarter of the long window."""
    ws = F.greatest(F.lit(10), F.least(F.lit(int(rate * short)), F.floor(F.col("_n") / 4)))
    wl = F.greatest(ws, F.least(F.lit(int(rate * long)), F.floor(F.col("_n") / 2)))
    step = F.greatest(F.lit(1), F.floor(wl / 4))
    dev = (F.col("_mad") + 1e-12) * 1.4826
    a = _points(s, value, ws, step, "dev", dev).select("clip", "at", (F.col("med") + k_short * F.col("dev")).alias("_short"))
    b = _points(s, value, wl, step, "dev", dev).select("clip", "at", (F.col("med") + k_long * F.col("dev")).alias("_long"))
    return interpolate(s, a.join(b, ["clip", "at"]), ["_short", "_long"]).withColumn("threshold", F.greatest("_short", "_long")).drop("_short", "_long")


def local_maxima(s: DataFrame, value: str = "value") -> DataFrame:
    """Rows that are strict local maxima; of a plateau the middle sample (the left one of two).  Edges are never maxima."""
    w = by_clip()
    new = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    x = s.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy("clip", "_run").agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"), F.min(value).alias("_v"))
    o = Window.partitionBy("clip").orderBy("_run")
    up = (F.lag("_v").over(o) < F.col("_v")) & (F.lead("_v").over(o) < F.col("_v"))
    peaks = g.withColumn("_up", up)
    at = peaks.where("_up").select("clip", F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("long").alias("idx"))
    return s.join(at, ["clip", "idx"], "left_semi")


def spectral_flux(frames: DataFrame, low: int, high: int) -> DataFrame:
    """(clip, idx, flux): sum of the rises of log(1 + magnitude) over bins low to high (end excluded); 0 for the first frame."""
    logs = F.transform(F.slice("mag", low + 1, high - low), lambda m: F.log1p(m))
    x = frames.select("clip", "idx", logs.alias("_l"))
    rise = F.zip_with("_l", F.lag("_l").over(by_clip()), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return x.withColumn("_r", rise).select("clip", "idx", F.coalesce(F.aggregate("_r", F.lit(0.0), lambda a, v: a + v), F.lit(0.0)).alias("flux"))


def band_energy(frames: DataFrame, bands: list[tuple[int, int]], names: list[str]) -> DataFrame:
    """Adds, for each band of bins [low, high), the sum of squared magnitudes."""
    for (a, b), n in zip(bands, names):
        frames = frames.withColumn(n, F.aggregate(F.slice("mag", a + 1, b - a), F.lit(0.0), lambda s, m: s + m.cast("double") * m))
    return frames


def spectral_shape(frames: DataFrame) -> DataFrame:
    """Adds centroid (energy-weighted mean bin) and flatness (geometric mean of the magnitudes above 1e-9 over the arithmetic mean of all)."""
    energy = F.aggregate("mag", F.lit(0.0), lambda s, m: s + m.cast("double") * m)
    weighted = F.aggregate(F.transform("mag", lambda m, i: m.cast("double") * m * i), F.lit(0.0), lambda s, m: s + m)
    positive = F.filter(F.transform("mag", lambda m: m.cast("double")), lambda m: m > 1e-9)
    logs = F.aggregate(positive, F.lit(0.0), lambda s, m: s + F.log(m))
    total = F.aggregate("mag", F.lit(0.0), lambda s, m: s + m.cast("double"))
    x = frames.withColumn("_e", energy).withColumn("_w", weighted).withColumn("_n", F.size(positive)).withColumn("_g", logs).withColumn("_t", total)
    x = x.withColumn("centroid", F.coalesce(F.try_divide("_w", "_e"), F.lit(0.0)))
    x = x.withColumn("flatness", F.when(F.col("_n") > 0, F.exp(F.col("_g") / F.col("_n")) / (F.col("_t") / F.size("mag") + 1e-9)).otherwise(0.0))
    return x.drop("_e", "_w", "_n", "_g", "_t")


def attack_slope(s: DataFrame, window: int, rate: float, value: str = "value") -> DataFrame:
    """Adds attack: the steepest rise between neighbours in the last `window` steps, over window / rate; 0 for the first `window` samples."""
    rise = F.col(value) - F.lag(value).over(by_clip())
    x = s.withColumn("_rise", rise)
    top = F.max("_rise").over(by_clip().rowsBetween(-(window - 1), 0))
    return x.withColumn("attack", F.when(F.col("idx") >= window, top / (window / rate)).otherwise(0.0)).drop("_rise")


def attack_by_frame(s: DataFrame, hop: int) -> DataFrame:
    """(clip, idx, attack): the greatest attack of each `hop` samples."""
    return s.groupBy("clip", F.floor(F.col("idx") / hop).alias("idx")).agg(F.max("attack").alias("attack"))


def _around(marks: DataFrame, s: DataFrame, half: int, value: str) -> DataFrame:
    """Marks (clip, id, at) with samples idx in [at - half, at + half)."""
    width = 2 * half
    m = marks.select("clip", "id", "at").withColumn("_b", F.explode(F.sequence(F.floor((F.col("at") - half) / width), F.floor((F.col("at") + half - 1) / width))))
    x = s.select(F.col("clip").alias("_c"), "idx", F.col(value).alias("v"), F.floor(F.col("idx") / width).alias("_sb"))
    near = (F.col("idx") >= F.col("at") - half) & (F.col("idx") < F.col("at") + half)
    return m.join(x, (F.col("clip") == F.col("_c")) & (F.col("_b") == F.col("_sb")) & near).select("clip", "id", "at", "idx", "v")


def refine_onset(marks: DataFrame, s: DataFrame, half: int, share: float = 0.12, value: str = "value") -> DataFrame:
    """(clip, id, at, refined): the first sample around a mark that reaches share x the greatest; fewer than 4 samples leave it.

    With share 0, the sample before the steepest rise.
    """
    near = _around(marks, s, half, value)
    top = near.groupBy("clip", "id", "at").agg(F.max("v").alias("_top"), F.count("*").alias("_n"))
    x = near.join(top, ["clip", "id", "at"])
    if share > 0:
        found = x.groupBy("clip", "id", "at").agg(F.min(F.when((F.col("v") >= share * (F.col("_top") + 1e-12)) & (F.col("_n") >= 4), F.col("idx"))).alias("_r"))
    else:
        w = Window.partitionBy("clip", "id", "at").orderBy("idx")
        rise = x.withColumn("_d", F.lead("v").over(w) - F.col("v")).where("_d is not null and _n >= 4")
        found = rise.groupBy("clip", "id", "at").agg(F.max(F.struct("_d", (-F.col("idx")).alias("m"))).alias("_m")).select("clip", "id", "at", (-F.col("_m.m")).alias("_r"))
    return marks.select("clip", "id", "at").join(found, ["clip", "id", "at"], "left").select("clip", "id", "at", F.coalesce("_r", "at").alias("refined"))


def refine_peak(marks: DataFrame, s: DataFrame, half: int, value: str = "value") -> DataFrame:
    """(clip, id, at, refined): the first greatest sample around a mark; fewer than 2 samples leave it."""
    near = _around(marks, s, half, value)
    found = near.groupBy("clip", "id", "at").agg(F.max(F.struct("v", (-F.col("idx")).alias("m"))).alias("_m"), F.count("*").alias("_n"))
    return marks.select("clip", "id", "at").join(found, ["clip", "id", "at"], "left").select("clip", "id", "at", F.when(F.col("_n") >= 2, -F.col("_m.m")).otherwise(F.col("at")).alias("refined"))


def frame_difference(frames: DataFrame, scale: float = 255.0) -> DataFrame:
    """(clip, idx, motion): mean absolute difference of each frame's pixels from the frame before, over scale; from the second frame on."""
    before = F.lag("mag").over(by_clip())
    total = F.aggregate(F.zip_with("mag", before, lambda a, b: F.abs(a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    x = frames.withColumn("_m", total / (F.size("mag") * scale)).withColumn("_p", before)
    return x.where("_p is not null").select("clip", "idx", F.col("_m").alias("motion"))


def multi_frame_difference(frames: DataFrame, n: int, scale: float = 255.0) -> DataFrame:
    """(clip, idx, motion): differences of the last n frames in turn, the latest weighted most (0.3 to 1, normalised)."""
    diff = frame_difference(frames, scale)
    m = n - 1
    raw = [0.3 + 0.7 * i / (m - 1) if m > 1 else 1.0 for i in range(m)]
    total = F.lit(0.0)
    weight = F.lit(0.0)
    for i, w in enumerate(raw):
        v = F.lag("motion", m - 1 - i).over(by_clip())
        total = total + F.coalesce(v * w, F.lit(0.0))
        weight = weight + F.when(v.isNotNull(), F.lit(w)).otherwise(0.0)
    return diff.withColumn("_t", total).withColumn("_w", weight).select("clip", "idx", (F.col("_t") / F.col("_w")).alias("motion"))


def resample(s: DataFrame, n: int, value: str = "value") -> DataFrame:
    """(clip, idx, value): each series at n evenly spaced places from its first to its last sample, linear between samples."""
    size = s.groupBy("clip").agg(F.max("idx").alias("_m"))
    want = size.select("clip", "_m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    pos = F.col("k") * F.col("_m") / max(n - 1, 1)
    want = want.withColumn("_p", pos).withColumn("_i", F.floor("_p").cast("long")).withColumn("_f", F.col("_p") - F.col("_i"))
    after = F.lead(value).over(by_clip())
    x = s.select("clip", F.col("idx").alias("_i"), F.col(value).alias("_v"), after.alias("_n"))
    return want.join(x, ["clip", "_i"]).select("clip", F.col("k").cast("long").alias("idx"), F.when(F.col("_f") == 0, F.col("_v")).otherwise(F.col("_v") + F.col("_f") * (F.col("_n") - F.col("_v"))).alias("value"))


def decimate(s: DataFrame, most: int) -> DataFrame:
    """Every max(1, n // most)-th sample."""
    n = F.count("*").over(Window.partitionBy("clip"))
    return s.withColumn("_step", F.greatest(F.lit(1), F.floor(n / most))).where("idx % _step = 0").drop("_step")


def candidate_features(peaks: DataFrame, frames: DataFrame, before: int | str, after: int | str) -> DataFrame:
    """Band ratios, flatness, attack and flags of each peak (clip, idx, onset) over frames [idx - before, idx + after].

    frames: clip, idx, e_low, e_mid, e_high, flatness, attack.  The clip's 99.5th attack percentile is taken once.  before and
    after may name columns of both sides that hold a clip's own numbers.
    """
    ref = frames.groupBy("clip").agg(F.expr("percentile(attack, 0.995)").alias("_ref"))
    own = [c for c in (before, after) if isinstance(c, str)]
    before, after = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (before, after))
    width = before + after + 1
    p = peaks.select("clip", "idx", "onset", *own).withColumn("_b", F.explode(F.sequence(F.floor((F.col("idx") - before) / width), F.floor((F.col("idx") + after) / width))))
    f = frames.select(F.col("clip").alias("_c"), F.col("idx").alias("_i"), F.floor(F.col("idx") / width).alias("_fb"), "e_low", "e_mid", "e_high", "flatness", "attack")
    near = (F.col("_i") >= F.col("idx") - before) & (F.col("_i") <= F.col("idx") + after)
    x = p.join(f, (F.col("clip") == F.col("_c")) & (F.col("_b") == F.col("_fb")) & near).groupBy("clip", "idx", "onset")
    x = x.agg(*[F.avg(c).alias(c) for c in ("e_low", "e_mid", "e_high", "flatness")], F.max("attack").alias("attack")).join(ref, "clip")
    return features_of_means(x, "_ref")


def features_of_means(x: DataFrame, ref: str) -> DataFrame:
    """The candidate features of peaks whose windows' mean e_low, e_mid, e_high and flatness and greatest attack are known; ref, which goes, is their clip's attack percentile."""
    e = 1e-9
    x = x.withColumn("r1", F.col("e_mid") / (F.col("e_low") + e)).withColumn("r2", F.col("e_high") / (F.col("e_mid") + e))
    x = x.withColumn("r1_log", F.log(F.col("e_mid") + e) - F.log(F.col("e_low") + e)).withColumn("r2_log", F.log(F.col("e_high") + e) - F.log(F.col("e_mid") + e))
    x = x.withColumn("attack_norm", F.least(F.col("attack") / (F.col(ref) + e), F.lit(1.0))).withColumn("onset_log", F.log1p("onset"))
    x = x.withColumn("e_low_ratio", F.col("e_low") / (F.col("e_low") + F.col("e_mid") + F.col("e_high") + e))
    x = x.withColumn("e_high_ratio", F.col("r1") * F.col("r2") / (1 + F.col("r1") + F.col("r1") * F.col("r2") + e))
    x = x.withColumn("slam", (F.col("e_low_ratio") > 0.65) | ((F.col("e_low_ratio") > 0.55) & (F.col("flatness") < 0.22)))
    x = x.withColumn("metal", (F.col("r2_log") > 1.2) & (F.col("flatness") > 0.5) & (F.col("attack_norm") < 0.4))
    return x.withColumn("r1_penalty", F.greatest(F.lit(0.0), 0.7 - F.col("r1_log"))).drop(ref)
