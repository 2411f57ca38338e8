"""The improved detector's work for a clip: done once, for peaks alone, and with the numbers of the plain way."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, kernels, score
from tidemark.params import Selection
from tidemark.plans import q_signal

SF = "/root/testdata/sf0.001"


def test_noise_is_that_of_each_seed():
    """One generator that is set anew gives what default_rng(seed) gives, also for seeds that have no 32 bits, and refuses what that refuses."""
    for seeds in ([0, 1, 7, 99999, 2**31, 2**32 - 1, 1], [5, 2**32, 2**63 - 1], []):
        for seed, r in zip(seeds, kernels.generators(seeds), strict=True):
            want = np.random.default_rng(seed)
            np.testing.assert_array_equal(r.standard_normal(700), want.standard_normal(700))
            np.testing.assert_array_equal(r.integers(0, 9, 3, dtype=np.uint32), want.integers(0, 9, 3, dtype=np.uint32))
    with pytest.raises(ValueError):
        list(kernels.generators([3, -1]))


def test_a_sound_is_that_of_its_events():
    events = [{"id": 40 + i, "conf": 30.0 * i, "kind": k} for i, k in enumerate(["click", "view", "signup", "click", "click", "signup", "error"])]
    y = np.zeros(len(events) * 1280 + 9600)
    for i, e in enumerate(events):
        r, a = np.random.default_rng(e["id"]), i * 1280
        y[a : a + 1280] += r.normal(0, 0.001, 1280)
        if e["kind"] == "signup":
            y[a : a + 4800] += 0.4 * np.sin(2 * np.pi * 3000 * np.arange(4800) / 16000.0)
        elif e["kind"] == "click":
            y[a : a + 1600] += e["conf"] / 200 * r.normal(0, 0.5, 1600) * np.exp(-np.arange(1600) / (0.012 * 16000.0))
    np.testing.assert_array_equal(q_signal._sound(events), y)


def test_cepstral_bands_together_and_alone():
    r = np.random.default_rng(3)
    for sr in (8000, 16000, 44100):
        x = r.normal(size=sr) * np.linspace(0, 1, sr)
        times = np.concatenate([[0.0, 0.013, 0.97, 0.99, 1.2], r.uniform(0, 1, 150)]).tolist()
        np.testing.assert_allclose(kernels.mfcc_bands(x, sr, times), [kernels.mfcc_band(x, sr, t) for t in times], rtol=1e-9, atol=1e-12)
    assert len(kernels.mfcc_bands(x, sr, [])) == 0


def test_attack_of_frames_is_the_curves_greatest():
    r = np.random.default_rng(4)
    for sr, hop in ((8000, 256), (16000, 256), (48000, 256), (16000, 4)):
        for size in (1, 3, 160, 161, 500, 1024, 5000):
            env, k = np.abs(r.normal(size=size)), max(1, int(sr * 0.01))
            if size > 600:
                env[size // 3 : size // 2] = np.linspace(3, 0, size // 2 - size // 3)  # falls for longer than a window
            for n in (1, max(1, size // hop), size // hop + 3):
                curve = detect.attack_curve(env, sr, 0.01)
                want = np.pad(curve, (0, max(0, n * hop - size)))[: n * hop].reshape(n, hop).max(1)
                np.testing.assert_array_equal(detect.attack_frames(env, sr, 0.01, hop, n), want)


def test_medians_of_short_arrays():
    r = np.random.default_rng(6)
    for x in (r.normal(size=1), r.normal(size=10), r.integers(0, 3, 83).astype(float), np.array([1.0, np.nan, 2.0])):
        np.testing.assert_array_equal(detect._median(x), np.median(x))


def test_spectra_of_many_frames():
    x = np.random.default_rng(8).normal(size=(3 * kernels.FRAMES + 5) * 4 + 16)
    view = np.lib.stride_tricks.sliding_window_view(x, 16)[::4][: (len(x) - 16) // 4 + 1]
    np.testing.assert_array_equal(kernels.stft(x, 16, 4), np.abs(np.fft.rfft(view * np.hanning(16), axis=1)))


def test_peaks_are_transformed_together(monkeypatch):
    """A clip's transforms are as many as its parts' lengths and its frames' stretches, not as many as its peaks."""
    made = []
    monkeypatch.setattr(detect, "_each", lambda kernel, *a, **k: made.append(kernel))
    monkeypatch.setattr(detect, "features_of_means", lambda x, ref: x)
    detect.peak_features(None, mfcc=True)
    r = np.random.default_rng(9)
    x = r.normal(0, 0.002, 80000)
    for a in range(2000, 76000, 2100):
        x[a : a + 1600] += r.uniform(0.1, 0.9) * r.normal(0, 0.5, 1600) * np.exp(-np.arange(1600) / 192)
    calls, plain = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda *a, **k: calls.append(1) or plain(*a, **k))
    found = made[0]("a", 16000.0, x)
    assert len(found["idx"]) > 25 and len(calls) < 12


def test_candidates_are_read_once(spark):
    """What follows the candidates reads them once and deals them by clip, without a join: they are few joins and medians, not many."""
    shots, _ = detect.shots_improved(q_signal._sounds(spark, SF), decode=q_signal._sound)
    plan = shots._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan


@pytest.mark.parametrize("rows", [1, 40])
def test_confidence_by_windows_is_that_by_joins(spark, rows):
    r = np.random.default_rng(rows)
    table = [(None if k == 3 else f"c{k}", i, int(i // 4), float(r.choice([0.1, 0.4, r.uniform()])), *r.uniform(-0.2, 1.2, 3).tolist()) for k in range(4) for i in range(rows)]
    df = spark.createDataFrame(table, "clip string, id long, cluster long, score double, attack_norm double, e_high_ratio double, e_low_ratio double")
    one, two = (sorted(map(tuple, score.fingerprint_confidence(df, whole=w).select("clip", "id", "cluster", "score", "confidence").collect())) for w in (False, True))
    assert one == two and len(one) == 3 * rows


def test_shots_without_a_hard_gap_keep_their_scores(spark):
    shots, _ = detect.shots_improved(q_signal._sounds(spark, SF), s=Selection(hard_gap=0.0), decode=q_signal._sound)
    assert shots.where(F.col("score").isNull()).count() == 0 and shots.count() > 50


def test_silence_behind_a_sound_is_not_transformed(monkeypatch):
    x = np.zeros(60000)
    x[:20001] = np.random.default_rng(2).normal(size=20001)
    view = np.lib.stride_tricks.sliding_window_view(x, 1024)[::256]
    want, rows, plain = np.abs(np.fft.rfft(view * np.hanning(1024), axis=1)), [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda v, *a, **k: rows.append(len(v)) or plain(v, *a, **k))
    np.testing.assert_array_equal(kernels.stft(x), want)
    assert sum(rows) == 79  # of 231: the last one that begins within the sound begins at 78 x 256
    assert kernels.stft(np.zeros(5000)).max() == 0 and sum(rows) == 79


def test_lists_of_events_are_python_values():
    kind = pa.list_(pa.struct([("id", pa.int64()), ("conf", pa.float64()), ("kind", pa.string()), ("sure", pa.bool_())]))
    one = [{"id": i, "conf": None if i == 4 else i / 3, "kind": "ab"[i % 2], "sure": i > 2} for i in range(7)]
    for lists in ([one[:3], [], one[3:], one], [one, None, one[2:]], [[one[0], None], one], [[]]):
        column = pa.array(lists, kind)
        for part in (column, column.slice(1), column.slice(0, 1)):
            got = detect._cells(part) if len(part) else []
            assert got == part.to_pylist() and all(type(e["id"]) is int for x in got if x for e in x if e)


def test_clips_are_dealt_to_some_tasks_for_each_core(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(detect, "shots_improved", lambda audio, *a, **k: (seen.append(audio.rdd.getNumPartitions()) or spark.createDataFrame([], detect.SHOT), None))
    q_signal.improved_detector(spark, SF)
    assert seen[0] >= 4 * spark.sparkContext.defaultParallelism > int(spark.conf.get("spark.sql.shuffle.partitions"))
