"""Sounds that are made in the task, and what clips of one kind share."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import detect, kernels
from tidemark.plans import q_signal

SF = "/root/testdata/sf0.001"


def test_no_row_holds_a_decoded_sound(spark):
    rows = q_signal._sounds(spark, SF)
    assert isinstance(rows.schema["samples"].dataType.elementType, StructType)
    assert rows.select(F.sum(F.size("samples"))).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_decoded_in_the_task_as_decoded_before(spark):
    rows = q_signal._sounds(spark, SF).orderBy("clip").limit(4).collect()
    whole = spark.createDataFrame([(r.clip, r.sr, q_signal._sound(r.samples).tolist()) for r in rows], "clip string, sr double, samples array<double>")
    lazy = spark.createDataFrame(rows, q_signal._sounds(spark, SF).schema)
    for only in (True, False):
        one, two = (sorted(map(tuple, df.collect())) for df in (detect.beeps(whole, first_only=only), detect.beeps(lazy, first_only=only, decode=q_signal._sound)))
        assert one == two and one


def test_clips_share_the_answers_of_a_filter():
    kernels._answers.cache_clear()
    x = np.random.default_rng(0).normal(size=300)
    for _ in range(5):
        kernels.bandpass(x, 1000.0, 50.0, 200.0)
    assert kernels._answers.cache_info().misses == 4


def test_peak_features_are_those_of_the_frames(spark):
    from tidemark.operators.signal import candidate_features

    rows = q_signal._sounds(spark, SF).orderBy("clip").limit(3)
    frames = detect.frame_features(rows, mfcc=True, decode=q_signal._sound).cache()
    names = ["clip", "idx", "onset", "e_low", "r1_log", "r2_log", "flatness", "attack_norm", "e_low_ratio", "slam", "metal"]
    want = sorted(map(tuple, candidate_features(frames.where("peak"), frames, "before", "after").select(*names).collect()))
    have = sorted(map(tuple, detect.peak_features(rows, mfcc=True, decode=q_signal._sound).select(*names).collect()))
    assert want and [r[:2] + r[-2:] for r in have] == [r[:2] + r[-2:] for r in want]
    np.testing.assert_allclose([r[2:-2] for r in have], [r[2:-2] for r in want], rtol=1e-9, atol=1e-12)


def test_settings_that_share_a_curve_find_what_each_finds_alone(spark):
    from dataclasses import replace

    from tidemark.params import Legacy

    audio = q_signal._audio(spark, SF)
    base = q_signal._legacy()
    grid = [base, replace(base, prominence=0.4), replace(base, percentile=90.0), replace(base, smooth_ms=1.0, coef=1.0)]
    both = sorted((r.clip.setting, r.clip.clip, r.id, r.t, r.conf) for r in detect.legacy_grid(audio, grid).collect())
    alone = sorted((i, r.clip, r.id, r.t, r.conf) for i in (0, 2, 3) for r in detect.legacy_shots(audio, grid[i]).collect())
    assert alone and [r for r in both if r[0] != 1] == alone
