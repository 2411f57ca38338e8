"""Error audits: what was missed and what was found too much, with hints and a manifest for people to label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.matching import anti, asof_backward, asof_nearest, match_greedy_unused
from tidemark.operators.prefix import totals_before

FAR = 999_000_000
#: The ids of the error taxonomy's two lists are read from its own file; these are the record types.
RECORD_TYPES = ("_meta", "skip", "fp", "fn")


def false_positives(refs: DataFrame, dets: DataFrame, tolerance: int) -> DataFrame:
    """Detections without any reference within the tolerance, with the distance to the nearest (FAR without references)."""
    near = asof_nearest(dets.select("clip", "id", "t", "conf"), refs.select("clip", "id", "t"))
    return near.where(F.col("dt").isNull() | (F.col("dt") > tolerance)).select("clip", "id", "t", "conf", F.coalesce("dt", F.lit(FAR)).cast("long").alias("distance"))


def false_negatives(refs: DataFrame, dets: DataFrame, candidates: DataFrame, tolerance: int) -> DataFrame:
    """References left by the greedy match, with the nearest detection and candidate at any distance and the gap to the reference before."""
    r = refs.select("clip", "id", "t")
    w = Window.partitionBy("clip").orderBy("t", "id")
    gap = r.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("is_first", F.lag("t").over(w).isNull())
    missed = match_greedy_unused(r, dets, tolerance).where("det_id is null").select("clip", F.col("ref_id").alias("id"))
    fn = gap.join(missed, ["clip", "id"], "left_semi")
    fn = asof_nearest(fn, dets.select("clip", "id", "t")).withColumn("det_t", F.col("near.t")).withColumn("det_dt", F.col("dt")).drop("near", "dt")
    fn = asof_nearest(fn, candidates.select("clip", "id", "t", "conf"))
    return fn.select("clip", "id", "t", "gap", "is_first", "det_t", "det_dt", F.col("near.t").alias("cand_t"), F.col("dt").alias("cand_dt"), F.col("near.conf").alias("cand_conf"))


def fp_hints(fps: DataFrame, refs: DataFrame, beeps: DataFrame, tolerance: int, echo: int) -> DataFrame:
    """Adds the last reference strictly before, whether the detection may be its echo, and the time since the beep."""
    x = asof_backward(fps, refs.select("clip", "id", "t"), strict=True)
    x = x.withColumn("prev_ref", F.col("prev.t")).drop("prev").join(beeps.select("clip", F.col("t").alias("_beep")), "clip", "left")
    since = F.col("t") - F.col("prev_ref")
    maybe = F.coalesce((since > 0) & (since < echo), F.lit(False)) & (F.col("distance") > tolerance)
    return x.withColumn("echo", maybe).withColumn("since_beep", F.col("t") - F.col("_beep")).drop("_beep")


def fn_hints(fns: DataFrame, follow: int, reject: int, reject_conf: float, none: int) -> DataFrame:
    """Adds might_fast_follow, might_classifier_reject and might_no_stage1."""
    false = F.lit(False)
    return (
        fns.withColumn("might_fast_follow", F.coalesce(F.col("gap") < follow, false))
        .withColumn("might_classifier_reject", F.coalesce((F.col("cand_dt") <= reject) & (F.col("cand_conf") < reject_conf), false))
        .withColumn("might_no_stage1", F.col("cand_dt").isNull() | (F.col("cand_dt") > none))
    )


def manifest(fps: DataFrame, fns: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """Records for labelling, with audit ids clip|FP|0001 numbered across all clips in order of (clip, t, id).

    Numbers come from the records of the clips before (see prefix) and a place within the clip, so no task sees all records or all clips.
    """
    def numbered(df: DataFrame, kind: str) -> DataFrame:
        sizes = df.groupBy("clip").agg(F.count("*").alias("_c"))
        base = totals_before(sizes, "clip", "_c", "_base")
        place = F.row_number().over(Window.partitionBy("clip").orderBy("t", "id"))
        x = df.withColumn("_place", place).join(base, "clip")
        return x.select(F.lit(kind).alias("record_type"), F.format_string(f"%s|{kind.upper()}|%04d", F.col("clip").cast("string"), F.col("_base") + F.col("_place")).alias("audit_id"), "clip", F.lit(None).cast("string").alias("reason"), "t", (F.col("conf") if kind == "fp" else F.lit(None).cast("double")).alias("conf"), (F.col("distance") if kind == "fp" else F.col("det_dt")).alias("distance"), F.lit(None).cast("string").alias("human_primary"), F.lit("").alias("notes"))

    out = numbered(fps, "fp").unionByName(numbered(fns, "fn"))
    if skips is not None:
        none = {c: F.lit(None).cast(t) for c, t in out.dtypes if c not in ("record_type", "clip", "reason", "notes")}
        out = out.unionByName(skips.select(F.lit("skip").alias("record_type"), "clip", "reason", F.lit("").alias("notes")).withColumns(none))
    return out


def candidate_coverage(refs: DataFrame, candidates: DataFrame, tolerance: int) -> DataFrame:
    """For each clip, its references and those with a candidate within the tolerance."""
    none = anti(refs.select("clip", "id", "t"), candidates, tolerance, tolerance).groupBy("clip").agg(F.count("*").alias("_none"))
    n = refs.groupBy("clip").agg(F.count("*").alias("n"))
    return n.join(none, "clip", "left").select("clip", "n", (F.col("n") - F.coalesce("_none", F.lit(0))).alias("covered"))
