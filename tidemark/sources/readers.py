"""Readers of clips, sidecars and records.  All paths go through Spark's own file sources."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import rational_fps
from tidemark.sources.parse import prefix, stem
from tidemark.sources.wav import samples


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples in [-1, 1)) of a PCM WAV file of 1, 2, 3 or 4 bytes a sample; channels are averaged."""
    with wave.open(io.BytesIO(raw)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        data = w.readframes(w.getnframes())
    return rate, samples(data, width, channels)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(clip, path, sr, samples) of every .wav below a path; files that don't decode have an error instead of samples."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = []
            for p, raw in zip(rows["path"], rows["content"]):
                try:
                    sr, x = decode_wav(raw)
                    out.append((p, float(sr), x.tolist(), None))
                except (wave.Error, EOFError, KeyError) as e:
                    out.append((p, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "sr", "samples", "error"])

    return files.mapInPandas(run, "path string, sr double, samples array<double>, error string").withColumn("clip", stem(F.col("path")))


def read_sidecar(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(clip, line_no, line) of every file below a path whose name ends in suffix; the clip is the name without it."""
    x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    x = x.withColumn("_n", name).select(F.expr(f"substring(_n, 1, length(_n) - {len(suffix)})").alias("clip"), "value")
    return x.select("clip", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def with_prefix_fallback(clips: DataFrame, rows: DataFrame) -> DataFrame:
    """rows of each clip's own sidecar, or of the one named like the part before its first "-" if it has none."""
    own = rows.select("clip").distinct()
    named = clips.select("clip", prefix(F.col("clip")).alias("_p"))
    use = named.join(own.withColumn("_own", F.lit(True)), "clip", "left").select("clip", F.when(F.col("_own"), F.col("clip")).otherwise(F.col("_p")).alias("_k"))
    return use.join(rows.withColumnRenamed("clip", "_k"), "_k").drop("_k")


def probe(meta: DataFrame) -> DataFrame:
    """(clip, fps, duration_s, start_s) from probe records (clip, r_frame_rate, duration, start_time as text; N/A is missing)."""
    number = lambda c: F.col(c).try_cast("double")
    return meta.select("clip", rational_fps(F.col("r_frame_rate")).alias("fps"), number("duration").alias("duration_s"), F.coalesce(number("start_time"), F.lit(0.0)).alias("start_s"))


def frame_range(frames: DataFrame, t0: float, t1: float, fps: float) -> DataFrame:
    """Frames int(t0 fps) to int(t1 fps), both included."""
    return frames.where(F.col("idx").between(int(t0 * fps), int(t1 * fps)))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(rel_path, split) of a split file with lists train and val."""
    j = spark.read.schema("note string, train array<string>, val array<string>").option("multiLine", "true").json(path)
    both = [j.select(F.explode_outer(s).alias("rel_path"), F.lit(s).alias("split")) for s in ("train", "val")]
    return both[0].unionByName(both[1]).where("rel_path is not null")


def explicit_or_legacy(explicit: DataFrame, files: DataFrame) -> DataFrame:
    """The explicit split's rows that exist, if it has any; else of each folder the last name is val and the rest train."""
    have = files.select(F.concat_ws("/", "folder", "name").alias("rel_path"))
    given = explicit.join(have, "rel_path", "left_semi")
    some = given.limit(1).withColumn("_some", F.lit(True)).select("_some")
    return given.unionByName(split_legacy(files).join(F.broadcast(some), F.lit(True), "left_anti"))


def split_legacy(files: DataFrame) -> DataFrame:
    """(rel_path, split): in each folder the last name is val, the rest train."""
    n = F.row_number().over(Window.partitionBy("folder").orderBy(F.col("name").desc()))
    return files.select(F.concat_ws("/", "folder", "name").alias("rel_path"), F.when(n == 1, "val").otherwise("train").alias("split"))


def split_regenerate(files: DataFrame) -> DataFrame:
    """(rel_path, split) from sidecars: in each folder, but those of backups, the first name is val, the rest train."""
    x = files.where(~F.lower("folder").contains("backup"))
    n = F.row_number().over(Window.partitionBy("folder").orderBy("name"))
    return x.select(F.concat_ws("/", "folder", "name").alias("rel_path"), F.when(n == 1, "val").otherwise("train").alias("split"))


def split_by_folder(split: DataFrame, parts: tuple[str, ...] = ("train",)) -> DataFrame:
    """(folder, names) of the given parts."""
    x = split.where(F.col("split").isin(*parts)).select(F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("rel_path", r"([^/]*)$", 1).alias("name"))
    return x.groupBy("folder").agg(F.array_sort(F.collect_set("name")).alias("names"))


def annotation_folder(files: DataFrame) -> DataFrame:
    """The first folder, in order, that holds a cali or beep file; hidden and tmp folders are passed over."""
    ok = ~F.col("folder").rlike(r"(^|/)(\.[^/]*|tmp)(/|$)") & F.col("name").rlike(r"(cali|beep)\.txt$")
    return files.where(ok).agg(F.min("folder").alias("folder"))


def read_manifest(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """Records of a JSON Lines manifest, of some record types if named."""
    x = spark.read.json(path)
    return x.where(F.col("record_type").isin(*kinds)) if kinds else x


def read_label_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(audit_id, human_primary) of a CSV file; a byte order mark is dropped."""
    x = spark.read.option("header", "true").csv(path)
    return x.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in x.columns]).select("audit_id", "human_primary")


def beep_truth(files: DataFrame) -> DataFrame:
    """(clip, t) of beep sidecars (name, line_no, line): S<n> belongs to S<n>-main, any other key to itself; first lines only."""
    key = F.regexp_extract("name", r"^(.*)beep\.txt$", 1)
    clip = F.when(key.rlike(r"^S\d+$"), F.concat(key, F.lit("-main"))).otherwise(key)
    return files.where("line_no = 0").select(clip.alias("clip"), F.trim("line").try_cast("double").alias("t")).where("t is not null")


def cached(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """The Parquet table at path; if it isn't there (or rebuild is set), build() is written there first."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
