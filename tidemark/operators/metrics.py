"""Scores, summaries and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import f1, middle, nearest_rank, precision, recall


def counts(matches: DataFrame, dets: DataFrame, keys: tuple[str, ...] = ("clip",), clips: DataFrame | None = None) -> DataFrame:
    """n_gt, n_det, tp, fp, fn for each key.  fp is detections less matches, so it counts doubles within the tolerance."""
    m = matches.groupBy(*keys).agg(F.count("*").alias("n_gt"), F.count("det_id").alias("tp"))
    d = dets.groupBy(*keys).agg(F.count("*").alias("n_det"))
    out = m.join(d, list(keys), "full")
    if clips is not None:
        out = clips.join(out, list(keys), "left")
    n_gt, n_det, tp = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_gt", "n_det", "tp"))
    return out.select(*keys, n_gt.alias("n_gt"), n_det.alias("n_det"), tp.alias("tp"), (n_det - tp).alias("fp"), (n_gt - tp).alias("fn"))


def with_prf(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.select("*", precision(tp, fp).alias("precision"), recall(tp, fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def pooled(per_clip: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Micro scores: sums, then ratios; zeros for no clip."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_gt", "n_det", "tp", "fp", "fn")]
    return with_prf((per_clip.groupBy(*keys) if keys else per_clip).agg(F.count("*").alias("clips"), *sums))


def skip_accounting(clips: DataFrame, refs: DataFrame, beeps: DataFrame) -> DataFrame:
    """reason and number of clips: no_beep, no_ref, no_ref_after_beep, or used."""
    b = beeps.groupBy("clip").agg(F.min("t").alias("beep"))
    r = refs.groupBy("clip").agg(F.max("t").alias("last"))
    x = clips.select("clip").join(b, "clip", "left").join(r, "clip", "left")
    reason = F.when(F.col("beep").isNull(), "no_beep").when(F.col("last").isNull(), "no_ref").when(F.col("last") < F.col("beep"), "no_ref_after_beep").otherwise("used")
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def fp_bands(fps: DataFrame, high: float = 0.7, low: float = 0.4) -> DataFrame:
    band = F.when(F.col("conf") > high, "high").when(F.col("conf") >= low, "middle").otherwise("low")
    return fps.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("conf").alias("least"), F.max("conf").alias("most"), F.avg("conf").alias("mean"))


def errors(matches: DataFrame, fail_at: int | None = None) -> DataFrame:
    """n, mae, rmse, most and failures (errors of fail_at or more, and missing ones) of matched pairs."""
    e = F.col("dt").cast("double")
    failed = F.col("dt").isNull() | (F.col("dt") >= fail_at) if fail_at is not None else F.col("dt").isNull()
    return matches.agg(F.count("dt").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max("dt").alias("most"), F.count_if(failed).alias("failures"))


def weighted_mae(per_clip: DataFrame) -> DataFrame:
    """Mean of clips' mae weighted by n."""
    return per_clip.agg(F.sum("n").alias("n"), F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("mae")), F.sum(F.when(F.col("mae").isNotNull(), F.col("n")))), F.lit(0.0)).alias("mae"))


def quantiles_nearest_rank(df: DataFrame, value: str, key: str = "clip") -> DataFrame:
    """n, least, p10, p50, p90, most by nearest rank."""
    g = df.groupBy(key).agg(F.collect_list(value).alias("xs"))
    xs = F.col("xs")
    return g.select(key, F.size(xs).alias("n"), F.array_min(xs).alias("least"), nearest_rank(xs, 0.10).alias("p10"), middle(xs).alias("p50"), nearest_rank(xs, 0.90).alias("p90"), F.array_max(xs).alias("most"))


def quantiles_linear(df: DataFrame, value: str, qs: tuple[float, ...], key: str = "clip") -> DataFrame:
    """Exact percentiles with linear interpolation, as columns p<q x 1000>."""
    return df.groupBy(key).agg(*[F.expr(f"percentile({value}, {q})").alias(f"p{round(q * 1000)}") for q in qs])


#: Ranks of the sketch that brackets a percentile.
ACCURACY = 10_000


def percentile_by_ranges(df: DataFrame, value: str, q: float, key: str = "clip") -> DataFrame:
    """(key, n, percentile) as `percentile` gives it, for keys of any number of rows.

    A sketch brackets the percentile between two values of nearly its rank; then only the values in the bracket are counted,
    one row for each distinct one, and the rows below it added up.  (Keys of few rows have all values as their bracket: ranks of
    a sketch are off by one or two besides its error.)  Both passes aggregate before they shuffle, and no buffer
    holds a key's values.  Nulls don't count; a key without values has null.
    """
    eps = 3 / ACCURACY
    v = F.col(value).cast("double")
    rows = df.select(key, v.alias("_v"))
    edges = F.expr(f"percentile_approx(_v, array({max(0.0, q - eps)}D, {min(1.0, q + eps)}D), {ACCURACY})")
    stats = rows.groupBy(key).agg(F.count("_v").alias("n"), edges.alias("_e"), F.array(F.min("_v"), F.max("_v")).alias("_all"))
    stats = stats.select(key, "n", F.when(F.col("n") < 2 * ACCURACY, F.col("_all")).otherwise(F.col("_e")).alias("_e"))
    rank = F.lit(q) * (F.col("n") - 1)
    inside = F.when(F.col("_v") >= F.col("_e")[0], F.col("_v"))
    counted = rows.join(stats, key).where(F.col("_v") <= F.col("_e")[1]).groupBy(key, "n", inside.alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(key).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.struct(F.col("_upto"), F.col("_v"))))["_v"]
    found = counted.withColumn("_upto", upto).withColumn("_r", rank).groupBy(key, "n", "_r").agg(at(F.floor("_r")).alias("_a"), at(F.ceil("_r")).alias("_b"))
    missed = F.col("_a").isNull() | F.col("_b").isNull()
    exact = F.when(missed, F.raise_error("the sketch missed its rank")).otherwise(F.col("_a") + (F.col("_r") - F.floor("_r")) * (F.col("_b") - F.col("_a")))
    return stats.select(key, "n").join(found.select(key, exact.cast("double").alias("percentile")), key, "left")


def robust_z(df: DataFrame, value: str, key: str = "clip") -> DataFrame:
    """Adds z = (x - median) / (1.4826 (MAD + 1e-9) + 1e-9) within the key."""
    med = df.groupBy(key).agg(F.expr(f"percentile({value}, 0.5)").alias("_med"))
    x = df.join(med, key).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = x.groupBy(key).agg(F.expr("percentile(_dev, 0.5)").alias("_mad"))
    z = (F.col(value) - F.col("_med")) / ((F.col("_mad") + 1e-9) * 1.4826 + 1e-9)
    return x.join(mad, key).withColumn("z", z).drop("_med", "_dev", "_mad")


def moments(df: DataFrame, value: str, key: str = "clip") -> DataFrame:
    """n, mean, population deviation, least, most, median."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.expr(f"percentile({value}, 0.5)").alias("median"))


def pareto(rows: DataFrame, label: str, target: float = 0.8) -> DataFrame:
    """rank, count, share and cumulative share of each label, and whether it is among the first that reach the target."""
    by = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("n").desc(), label)  # one row for each label of a fixed taxonomy
    run = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    out = by.select(F.col(label).alias("label"), "n", F.row_number().over(order).alias("rank"), run.alias("_run"), total.alias("_total"))
    return out.select("label", "n", "rank", (100.0 * F.col("n") / F.col("_total")).alias("pct"), (100.0 * F.col("_run") / F.col("_total")).alias("cum_pct"), (F.col("_run") - F.col("n") < target * F.col("_total")).alias("within"))


def dataset_counts(clips: DataFrame, shots: DataFrame, beeps: DataFrame) -> DataFrame:
    s = shots.groupBy("clip").agg(F.count("*").alias("s"))
    b = beeps.groupBy("clip").agg(F.count("*").alias("b"))
    x = clips.select("clip").join(s, "clip", "left").join(b, "clip", "left").na.fill(0, ["s", "b"])
    return x.agg(F.count("*").alias("clips"), F.sum("s").alias("shots"), F.sum("b").alias("beeps"), F.avg("s").alias("shots_per_clip"), F.count_if(F.col("s") == 0).alias("without_shots"), F.count_if(F.col("b") == 0).alias("without_beep"))


def dynamic_window(df: DataFrame, share: float, low: int, high: int) -> DataFrame:
    """(clip, window): share x the median gap, held in [low, high]; low for fewer than three rows."""
    gap = df.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("clip").orderBy("t", "id")))
    g = gap.groupBy("clip").agg(F.count("*").alias("n"), F.expr("percentile(gap, 0.5)").alias("m"))
    return g.select("clip", F.when(F.col("n") < 3, F.lit(float(low))).otherwise(F.least(F.greatest(F.col("m") * share, F.lit(float(low))), F.lit(float(high)))).alias("window"))


def class_means(df: DataFrame, features: str, label: str) -> DataFrame:
    """feature number, mean for label 1, mean for label 0, difference."""
    x = df.select(F.col(label).cast("int").alias("y"), F.posexplode(features).alias("i", "v"))
    return x.groupBy("i").agg(F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("pos"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("neg")).withColumn("diff", F.col("pos") - F.col("neg"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties sharing; and precision, recall, f1 at 0.5.

    Scores are reduced to counts by distinct value and dealt into ranges at approximate quantiles; a range's sums and the
    places within it give the ranks, so the ranking is not one task.  The quantiles are numbers in the plan: every part of it sees the same ranges.
    """
    by = df.groupBy(score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) != 1).cast("long")).alias("_q"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.stat.approxQuantile(score, [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(score))) if cuts else F.lit(0)
    dealt = by.withColumn("_part", part)
    sums = dealt.groupBy("_part").agg(F.sum("_q").alias("_qs"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = sums.select("_part", F.coalesce(F.sum("_qs").over(before), F.lit(0)).alias("_base"))
    below = F.col("_base") + F.coalesce(F.sum("_q").over(Window.partitionBy("_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = dealt.join(F.broadcast(base), "_part").withColumn("_below", below)
    tp = F.coalesce(F.sum(F.when(F.col(score) >= 0.5, F.col("_p"))), F.lit(0))
    fp = F.coalesce(F.sum(F.when(F.col(score) >= 0.5, F.col("_q"))), F.lit(0))
    out = area.agg(F.sum("_p").alias("pos"), F.sum("_q").alias("neg"), F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)).alias("_a"), tp.alias("tp"), fp.alias("fp"))
    fn = F.col("pos") - F.col("tp")
    return out.select("pos", "neg", F.coalesce(F.try_divide(F.col("_a"), (F.col("pos") * F.col("neg")).cast("double")), F.lit(0.0)).alias("auc"), precision(F.col("tp"), F.col("fp")).alias("precision"), recall(F.col("tp"), fn).alias("recall"), f1(F.col("tp"), F.col("fp"), fn).alias("f1"))
