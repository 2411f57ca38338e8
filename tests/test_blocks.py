"""Operators over blocks equal the kernels over whole clips, wherever a clip is cut; WAV files in blocks equal whole ones."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, detect, kernels
from tidemark.params import Candidates, Stft
from tidemark.sources import readers, wav

SR = 800.0
SMALL = Stft(n_fft=64, hop=16, low_hz=20, high_hz=300, bands=((20, 80), (80, 200), (200, 400)))
LENGTHS = {"long": 1500, "even": 640, "short": 40, "one": 1}


def signals():
    rng = np.random.default_rng(5)
    return {c: np.round(rng.normal(0, 1, n) * (1 + np.arange(n) % 97 / 20), 2) for c, n in LENGTHS.items()}


def series(spark, clips):
    rows = [(c, i, float(v)) for c, x in clips.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "clip string, idx long, value double").repartition(3)


def audio(spark, clips):
    return spark.createDataFrame([(c, SR, x.tolist()) for c, x in clips.items()], "clip string, sr double, samples array<double>")


def equal(got, want, names, digits=9):
    key = lambda r: (r["clip"], r["idx"])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for n in names:
        np.testing.assert_allclose(np.array([r[n] for r in got], float), np.array([r[n] for r in want], float), rtol=10**-digits, atol=10**-digits)


@pytest.mark.parametrize("size", [7, 64, 200, 1500, 4000])
def test_halo_gives_each_block_its_surroundings(spark, size):
    clips = signals()
    got = blocks.halo(blocks.as_blocks(series(spark, clips), SR, size), size, 30, 63).collect()
    assert sorted((r["clip"], r["block"]) for r in got) == [(c, k) for c in sorted(clips) for k in range(-(-len(clips[c]) // size))]
    for r in got:
        x, a = clips[r["clip"]], r["block"] * size
        assert (r["start"], r["own"], r["lead"]) == (a, min(size, len(x) - a), min(30, a))
        assert r["samples"] == x[max(0, a - 30) : a + size + 63].tolist()


@pytest.mark.parametrize("size", [10, 16, 100, 333, 4000])
def test_frames_and_features(spark, size):
    clips = signals()
    cut, whole = blocks.as_blocks(series(spark, clips), SR, size), audio(spark, clips)
    equal(blocks.stft_frames(blocks.halo(cut, size, *blocks.stft_reach(SMALL)), SMALL).collect(), detect.stft_frames(whole, SMALL).collect(), ["mag"])
    c = Candidates(envelope=0.01, attack=0.02)
    got = blocks.frame_features(blocks.halo(cut, size, *blocks.feature_reach(SR, SMALL, c)), SMALL, c)
    equal(got.collect(), detect.frame_features(whole, SMALL, c).collect(), ["onset", "e_low", "e_mid", "e_high", "flatness", "attack"])


def test_features_with_a_smoothed_onset(spark):
    """At hops of less than 5 ms the onset is averaged over several frames."""
    p, clips = Stft(n_fft=16, hop=2, low_hz=20, high_hz=300, bands=((20, 80), (80, 200), (200, 400))), {k: v for k, v in signals().items() if k != "one"}
    got = blocks.frame_features(blocks.halo(blocks.as_blocks(series(spark, clips), SR, 50), 50, *blocks.feature_reach(SR, p)), p)
    equal(got.collect(), detect.frame_features(audio(spark, clips), p).collect(), ["onset", "e_low", "flatness", "attack"])


@pytest.mark.parametrize("size", [3, 256, 300, 4000])
def test_recursive_filter_carries_its_states(spark, size, monkeypatch):
    clips = signals()
    monkeypatch.setattr(blocks, "RUN", 23)  # also where there are several levels of runs
    found = blocks.bandpass(blocks.as_blocks(series(spark, clips), SR, size), size, 5.0, 60.0).collect()
    for c, x in clips.items():
        y = np.concatenate([r["samples"] for r in sorted((r for r in found if r["clip"] == c), key=lambda r: r["block"])])
        want = kernels.bandpass(x, SR, 5.0, 60.0)
        assert len(y) == len(x) and np.abs(y - want).max() <= 1e-12 * max(1, np.abs(want).max())


def test_filter_from_any_state():
    x, s = signals()["long"], kernels.butter_band(4, 0.05, 0.4)
    whole = kernels.filter_causal(s, x)
    for at in (1, 255, 256, 700, 1499):
        a, state = kernels.filter_from(s, x[:at], np.zeros((4, 2)))
        b, end = kernels.filter_from(s, x[at:], state)
        np.testing.assert_allclose(np.concatenate([a, b]), whole, atol=1e-12)
        np.testing.assert_allclose(end, kernels.filter_from(s, x, np.zeros((4, 2)))[1], atol=1e-12)
    np.testing.assert_allclose(kernels.decay(s, 300) @ state.ravel(), kernels.filter_from(s, np.zeros(300), state)[1].ravel(), atol=1e-12)


def plain_prominence(x, p):
    sides = []
    for part in (x[:p][::-1], x[p + 1 :]):
        low = x[p]
        for v in part:
            if v > x[p]:
                break
            low = min(low, v)
        sides.append(low)
    return x[p] - max(sides)


@pytest.mark.parametrize("size", [1, 5, 64, 4000])
@pytest.mark.parametrize("shape", ["noise", "steps", "rising", "falling"])
def test_prominence_of_a_clip_cut_anywhere(spark, size, shape, monkeypatch):
    monkeypatch.setattr(blocks, "RUN", 20)
    n = 390
    x = {"noise": np.random.default_rng(1).normal(size=n), "steps": np.floor(np.random.default_rng(2).normal(size=n) * 2), "rising": np.arange(n) + 3.0 * (np.arange(n) % 2), "falling": -np.arange(n) + 3.0 * (np.arange(n) % 2)}[shape]
    at = kernels.find_maxima(x)
    cut = blocks.as_blocks(series(spark, {"c": x, "d": -x}), SR, size)
    peaks = spark.createDataFrame([("c", int(p)) for p in at] + [("d", int(p)) for p in kernels.find_maxima(-x)], "clip string, idx long")
    found = {(r["clip"], r["idx"]): r["prominence"] for r in blocks.prominences(cut, peaks, size).collect()}
    want = {("c", int(p)): plain_prominence(x, p) for p in at} | {("d", int(p)): plain_prominence(-x, p) for p in kernels.find_maxima(-x)}
    assert found == pytest.approx(want) and len(want) > 100


def test_too_many_blocks_are_refused(spark, monkeypatch):
    monkeypatch.setattr(blocks, "RUN", 5)
    with pytest.raises(Exception, match="more than 25 blocks"):
        blocks.bandpass(blocks.as_blocks(series(spark, {"c": np.ones(30)}), SR, 1), 1, 5.0, 60.0).collect()


def test_mel_patches(spark):
    clips = {k: v for k, v in signals().items() if k != "one"}
    marks = spark.createDataFrame([(c, k, int(t * 1e6)) for c, x in clips.items() for k, t in enumerate((0, 0.01, len(x) / SR / 2, len(x) / SR, len(x) / SR + 3))], "clip string, id long, t long")
    cut = blocks.halo(blocks.as_blocks(series(spark, clips), SR, 100), 100, 0, 200)
    for options in ({"before": 0.05, "after": 0.08}, {"before": 0.0, "after": 0.2, "centre": False, "frames": 4}):
        got = {(r["clip"], r["id"]): np.array(r["patch"]) for r in blocks.mel_patches(cut, marks, 100, SR, n_mels=8, **options).collect()}
        want = {(r["clip"], r["id"]): np.array(r["patch"]) for r in detect.mel_patches(audio(spark, clips), marks, n_mels=8, **options).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def write(path, rate, width, channels, data):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)


@pytest.mark.parametrize("block,part", [(1000, 1 << 20), (7, 500), (64, 44), (100000, 3000)])
def test_wav_files_in_blocks(spark, tmp_path, block, part):
    rng = np.random.default_rng(block)
    (tmp_path / "sub").mkdir()
    for name, width, channels, n in (("a", 1, 1, 501), ("b", 2, 2, 1000), ("c", 3, 1, 333), ("sub/d", 4, 3, 64), ("e", 2, 1, 0)):
        write(tmp_path / f"{name}.wav", 8000, width, channels, rng.integers(0, 256, n * width * channels, dtype=np.uint8).tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVEnothing")
    (tmp_path / "other.txt").write_text("no clip")
    found = wav.read_blocks(spark, str(tmp_path), block, before=3, after=5, partition_bytes=part).collect()
    assert {r["clip"]: r["error"] is None for r in found} == dict.fromkeys("abcde", True) | {"bad": False}
    for r in readers.read_wav(spark, str(tmp_path)).where("error is null").collect():
        x = r["samples"]
        own = sorted((b for b in found if b["clip"] == r["clip"]), key=lambda b: b["block"])
        assert [b["block"] for b in own] == list(range(max(1, -(-len(x) // block))))
        for b in own:
            a = b["start"]
            assert (a, b["own"], b["lead"], b["sr"]) == (b["block"] * block, min(block, len(x) - a), min(3, a), 8000.0)
            assert b["samples"] == x[max(0, a - 3) : a + block + 5]


def test_wav_of_floats_and_of_unknown_length(spark, tmp_path):
    x = np.linspace(-1, 1, 300, dtype="<f4")
    fmt = struct.pack("<HHIIHH", 3, 1, 8000, 32000, 4, 32)
    body = b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 0xFFFFFFFF) + x.tobytes()
    (tmp_path / "f.wav").write_bytes(b"RIFF" + struct.pack("<I", 0xFFFFFFFF) + body)
    found = sorted(wav.read_blocks(spark, str(tmp_path / "f.wav"), 128).collect(), key=lambda r: r["block"])
    assert [v for r in found for v in r["samples"]] == x.astype(float).tolist()


def test_partitions_are_bounded(tmp_path):
    """A long file is many ranges, and short ones share one."""
    write(tmp_path / "long.wav", 8000, 2, 1, bytes(100000))
    for k in range(9):
        write(tmp_path / f"s{k}.wav", 8000, 2, 1, bytes(100))
    parts = wav.WavReader({"path": str(tmp_path), "partitionbytes": "20000"}).partitions()
    assert max(sum(b - a for _, _, a, b in p.parts) for p in parts) <= 20000
    wide = wav.WavReader({"path": str(tmp_path), "partitionbytes": str(64 << 20)}).partitions()
    assert len(wide) == 1 and len(wide[0].parts) == 10


@pytest.mark.parametrize("size", [1, 2, 9, 4000])
def test_maxima_of_plateaus_over_edges(spark, size):
    rng = np.random.default_rng(size)
    clips = {"p": np.repeat(rng.integers(0, 4, 120), rng.integers(1, 7, 120)).astype(float), "flat": np.ones(30), "one": np.ones(1), "two": np.array([1.0, 2.0])}
    found = {(r["clip"], r["idx"]): r["value"] for r in blocks.local_maxima(blocks.as_blocks(series(spark, clips), SR, size), size).collect()}
    want = {}
    for c, x in clips.items():
        edges = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
        for a, b in zip(edges, edges[1:]):
            if a > 0 and b < len(x) and x[a - 1] < x[a] and x[b] < x[a]:
                want[c, (a + b - 1) // 2] = x[a]
    assert found == want


def plain_suppression(rows, distance):
    """Of (t, id, conf), the best row of all that are left, again and again."""
    left, kept = list(rows), []
    while left:
        best = max(left, key=lambda r: (r[2], r[0], r[1]))
        kept.append(best)
        left = [r for r in left if r is not best and abs(r[0] - best[0]) >= distance]
    return sorted(kept)


@pytest.mark.parametrize("shape", ["noise", "ties", "rising", "falling", "dense"])
def test_suppression_in_small_batches(spark, shape):
    """Batches of a few rows in one long stretch: rows stay open over many batches where confidence rises."""
    from tidemark.operators import dedup

    rng, n, distance = np.random.default_rng(3), 160, 7
    t = np.sort(rng.integers(0, 40 if shape == "dense" else 300, n)).tolist()
    conf = {"noise": rng.normal(size=n), "ties": rng.integers(0, 3, n) * 1.0, "rising": np.arange(n) * 1.0, "falling": -np.arange(n) * 1.0, "dense": rng.normal(size=n)}[shape].tolist()
    rows = [("a", i, t[i], conf[i]) for i in range(n)] + [("b", i, t[i], conf[-1 - i]) for i in range(n)] + [("c", 0, 5, 1.0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = dedup.suppress_priority(spark.createDataFrame(rows, "clip string, id long, t long, conf double"), distance).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for clip in "abc":
        want = plain_suppression([(r[2], r[1], r[3]) for r in rows if r[0] == clip], distance)
        assert sorted((r["t"], r["id"], r["conf"]) for r in found if r["clip"] == clip) == want


def test_what_is_open_stays_small():
    """In noise, the rows that later ones may still change are a few distances long, however long the stretch."""
    rng = np.random.default_rng(0)
    at, height = np.arange(200_000), rng.normal(size=200_000)
    keep, open_ = kernels.settle(at, height, 20, False)
    assert open_.sum() < 500 and np.array_equal(keep[:199_000], kernels.thin_by_height(at, height, 20)[:199_000])


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.92, 0.995, 1.0])
def test_percentiles_without_a_buffer(spark, q):
    from tidemark.operators import metrics

    rng = np.random.default_rng(9)
    clips = {"many": np.round(rng.normal(size=60_000) ** 3, 3), "ties": np.repeat([1.0, 2.0, 5.0], [9_000, 20_000, 1_000]), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([4.0])}
    import pandas as pd

    rows = spark.createDataFrame(pd.concat([pd.DataFrame({"clip": c, "v": x}) for c, x in clips.items()]), "clip string, v double")
    nulls = spark.createDataFrame([("none", None), ("many", None)], "clip string, v double")
    found = {r["clip"]: r for r in metrics.percentile_by_ranges(rows.union(nulls), "v", q).collect()}
    for c, x in clips.items():
        assert found[c]["n"] == len(x) and found[c]["percentile"] == pytest.approx(np.percentile(x, 100 * q), rel=1e-12)
    assert found["none"]["percentile"] is None
