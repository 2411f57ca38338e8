"""Documents and tables that a run leaves behind."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def events_document(clips: DataFrame, shots: DataFrame, beeps: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """(clip, document): one JSON object a clip, with its beeps, shots in order, times since the first beep, and matched ids."""
    s = shots.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", "id", "conf"))).alias("shots"))
    b = beeps.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("beeps"))
    x = clips.join(b, "clip", "left").join(s, "clip", "left")
    t0 = F.coalesce(F.get(F.col("beeps"), F.lit(0))["t"], F.lit(0))
    since = F.transform("shots", lambda r: (r["t"] - t0) / 1e6)
    parts = [F.struct(*[c for c in clips.columns]).alias("video"), (t0 / 1e6).alias("t0_beep_s"), F.col("beeps"), F.col("shots"), since.alias("shot_times_since_beep")]
    if matches is not None:
        m = matches.groupBy("clip").agg(F.array_sort(F.collect_list(F.when(F.col("status") == "matched", F.struct("audio_id", "motion_id")))).alias("matched"))
        x = x.join(m, "clip", "left")
        parts.append(F.struct("matched").alias("validation"))
    return x.select("clip", F.to_json(F.struct(*parts)).alias("document"))


def relative_times(shots: DataFrame, beeps: DataFrame, digits: int = 4) -> DataFrame:
    """(clip, line_no, line): three comment lines, then one time since the first beep a line, in order."""
    t0 = beeps.groupBy("clip").agg(F.min("t").alias("t0"))
    x = shots.join(t0, "clip", "left").withColumn("s", (F.col("t") - F.coalesce("t0", F.lit(0))) / 1e6)
    n = F.row_number().over(Window.partitionBy("clip").orderBy("t", "id"))
    body = x.select("clip", (n + 2).alias("line_no"), F.format_string(f"%.{digits}f", F.col("s")).alias("line"))
    heads = ["# shot times since the beep", "# seconds", "# one per line"]
    top = shots.select("clip").distinct().select("clip", F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("line_no", "line"))
    return top.unionByName(body)


def benchmark_record(pooled: DataFrame, tag: str, split: str, config: dict) -> DataFrame:
    """One row to append as JSON: meta with the first 16 digits of the split's and the settings' SHA-256, and the pooled scores."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    meta = F.struct(F.lit(tag).alias("tag"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_utc"), F.left(F.sha2(F.lit(split), 256), F.lit(16)).alias("split_sha256"), F.lit(digest).alias("config_sha256"))
    return pooled.select(meta.alias("meta"), F.struct(*pooled.columns).alias("pooled"))


def append_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").json(path)


def latest(history: DataFrame, key: str, at: str) -> DataFrame:
    """The last record of each key: the view that replaces an upserted file."""
    rest = [c for c in history.columns if c not in (key, at)]
    return history.groupBy(key).agg(F.max(at).alias(at), *[F.max_by(c, at).alias(c) for c in rest])


def overlay_labels(frame_labels: DataFrame, confirmed: DataFrame, clips: DataFrame) -> DataFrame:
    """One row a labelled frame: the shot's number and its colour, green if confirmed by motion, else red."""
    c = confirmed.select("clip", "shot", "motion_confirmed")
    return frame_labels.join(c, ["clip", "shot"], "left").join(clips, "clip", "left_semi").select("clip", "frame", "shot", F.when(F.col("motion_confirmed"), "green").otherwise("red").alias("colour"))


def rewrite_cali(preamble: DataFrame, times: DataFrame) -> DataFrame:
    """(clip, text): the kept preamble, then one time a line in order, four decimals."""
    b = times.groupBy("clip").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    body = F.array_join(F.transform("ts", lambda t: F.format_string("%.4f", t)), "\n")
    return b.join(preamble, "clip", "left").select("clip", F.concat_ws("\n", "preamble", body).alias("text"))


def to_absolute(times: DataFrame, start: DataFrame, digits: int = 4) -> DataFrame:
    """Times moved behind the beep."""
    return times.join(start, "clip").select("clip", "idx", F.round(F.col("t0") + F.col("t"), digits).alias("t"))


def to_relative(times: DataFrame, start: DataFrame, slack: float = 0.5, digits: int = 4) -> DataFrame:
    """Times less the beep, for clips whose least time is at most `slack` before it; others stay as they are."""
    low = F.min("t").over(Window.partitionBy("clip"))
    x = times.join(start, "clip").withColumn("_low", low)
    return x.select("clip", "idx", F.round(F.when(F.col("_low") >= F.col("t0") - slack, F.col("t") - F.col("t0")).otherwise(F.col("t")), digits).alias("t"))


def to_splits(times: DataFrame, digits: int = 4) -> DataFrame:
    """The first time, then the gaps."""
    w = Window.partitionBy("clip").orderBy("idx")
    return times.select("clip", "idx", F.round(F.col("t") - F.coalesce(F.lag("t").over(w), F.lit(0.0)), digits).alias("split"))


def motion_features(stats: DataFrame, series: DataFrame) -> DataFrame:
    """(clip, ref_id, document): one JSON object for each reference: its window's statistics, then motion_signal and time_signal."""
    rest = [c for c in stats.columns if c not in ("clip", "ref_id")]
    x = stats.join(series, ["clip", "ref_id"])
    signal = F.transform("series", lambda r: F.round(r["value"], 6)).alias("motion_signal")
    time = F.transform("series", lambda r: F.round(r["t"] / 1e6, 4)).alias("time_signal")
    return x.select("clip", "ref_id", F.to_json(F.struct("clip", "ref_id", *rest, signal, time)).alias("document"))
