import io
import itertools
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, kernels, score
from tidemark.params import Beep
from tidemark.sources import parse, readers, sinks

SR = 48000
ONSETS = (0.173, 0.6567, 1.4694, 2.3053, 3.1238)


def clip(seed=0, beep=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.001, int(3.5 * SR))
    for t in ONSETS:
        n = int(0.12 * SR)
        a = int(t * SR)
        x[a : a + n] += (rng.normal(0, 0.5, n) * np.exp(-np.arange(n) / (0.015 * SR)))[: len(x) - a]
    if beep is not None:
        a, n = int(beep * SR), int(0.3 * SR)
        x[a : a + n] += 0.4 * np.sin(2 * np.pi * 3000 * np.arange(n) / SR)
    return x


def audio(spark, x, **more):
    df = spark.createDataFrame([("g", float(SR), x.tolist())], "clip string, sr double, samples array<double>")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def near(found, tol=0.05):
    return [min(abs(t - f) for f in found) <= tol for t in ONSETS]


def test_energy_detector_finds_the_clicks(spark):
    t = [r.t / 1e6 for r in detect.energy_shots(audio(spark, clip())).where("value > 0.1").collect()]
    assert all(near(t)) and len(t) <= 12


def test_improved_detector_finds_the_clicks(spark):
    shots, candidates = detect.shots_improved(audio(spark, clip()))
    t = [r.t / 1e6 for r in shots.collect()]
    assert all(near(t)) and len(t) <= 12
    assert candidates.count() >= len(t)


def test_beep_is_found_and_refined(spark):
    x = clip(beep=1.9)
    t = detect.beeps(audio(spark, x, about=1.8), Beep(head=0.15)).first().t / 1e6
    assert abs(t - 1.9) < 0.35
    assert abs(detect.beep_near(audio(spark, x, about=2.0), 0.5).first().t / 1e6 - 1.9) < 0.35
    marks = spark.createDataFrame([("g", 0, 1900000), ("g", 1, 3499000)], "clip string, id long, t long")
    hz = {r.id: r.hz for r in detect.dominant_frequencies(audio(spark, x), marks).collect()}
    assert hz[0] == pytest.approx(3000, abs=30) and hz[1] is None


def test_silence_has_nothing(spark):
    x = np.zeros(SR)
    assert detect.energy_shots(audio(spark, x)).count() == 0
    assert detect.beeps(audio(spark, x)).count() == 0


def recurrence(sections, x):
    y = x
    for b0, b1, b2, a1, a2 in sections:
        out = np.zeros(len(y))
        for i in range(len(y)):
            out[i] = b0 * y[i] + (b1 * y[i - 1] - a1 * out[i - 1] if i else 0) + (b2 * y[i - 2] - a2 * out[i - 2] if i > 1 else 0)
        y = out
    return y


def gain(sections, w):
    return np.abs(np.prod([(b0 + b1 * w + b2 * w**2) / (1 + a1 * w + a2 * w**2) for b0, b1, b2, a1, a2 in sections], axis=0))


def test_filter_equals_the_recurrence():
    sections = kernels.butter_band(4, 400 / 24000, 6000 / 24000)
    x = np.random.default_rng(1).normal(size=1500)
    for n in (0, 1, 255, 256, 257, 1500):
        assert np.allclose(kernels.filter_causal(sections, x[:n]), recurrence(sections, x[:n]), atol=1e-9)
    got = gain(sections, np.exp(-2j * np.pi * np.array([1500, 20, 20000]) / SR))
    assert got[0] == pytest.approx(1, abs=1e-3) and got[1] < 1e-3 and got[2] < 1e-2


def test_band_edges_are_half_power():
    assert gain(kernels.butter_band(4, 0.1, 0.4), np.exp(-1j * np.pi * np.array([0.1, 0.4]))) == pytest.approx([2**-0.5] * 2, abs=1e-6)


def test_motion_features_as_json(spark):
    refs = spark.createDataFrame([("a", 1, 100)], "clip string, id long, t long")
    frames = spark.createDataFrame([("a", k, 40 * k, k / 3) for k in range(6)], "clip string, id long, t long, value double")
    from tidemark.operators import matching

    doc = sinks.motion_features(matching.window_stats(refs, frames, 30, 60), matching.window_series(refs, frames, 30, 60)).first().document
    got = json.loads(doc)
    assert got["motion_signal"] == [round(k / 3, 6) for k in (2, 3, 4)] and got["time_signal"] == [0.0001, 0.0001, 0.0002] and got["n"] == 3


def test_maxima_and_plateaus():
    assert kernels.find_maxima(np.array([0, 2, 2, 2, 1, 3, 3, 0, 5, 5])).tolist() == [2, 5]
    assert kernels.find_maxima(np.array([1.0, 1.0])).tolist() == []
    x = np.array([0, 1, 0, 3, 0, 2, 0.0])
    assert kernels.find_peaks(x, distance=3).tolist() == [3]
    assert kernels.find_peaks(x, height=1.5).tolist() == [3, 5]
    assert kernels.prominences(np.array([0, 4, 2, 5, 1, 3, 0.0]), np.array([1, 3, 5])).tolist() == [2, 5, 2]


def test_moving_average_offsets():
    x = np.zeros(7)
    x[3] = 1
    assert np.flatnonzero(kernels.moving_average(x, 2)).tolist() == [3, 4]
    assert np.flatnonzero(kernels.moving_average(x, 3)).tolist() == [2, 3, 4]
    assert np.allclose(kernels.moving_average(x, 4), np.convolve(x, np.ones(4) / 4, "same"))


def test_second_recovery_counts_what_it_found():
    x = np.array([0, 10, 0, 0, 6, 0, 0, 5, 0, 0, 1, 0.0])
    got = kernels.recover_second(x, np.full(12, 8.0), np.array([1]), 0.5, 2, 8, 3)
    assert got.tolist() == [1, 4, 7]


def test_mel_patch_shape_and_padding():
    x = np.sin(2 * np.pi * 1000 * np.arange(SR) / SR)
    assert kernels.mel_patch(x, SR, 0.5).shape == (64, 32)
    m = kernels.mel_spectrogram(x, SR)
    centre = kernels._hz(np.linspace(0, kernels._mel(8000), 66))[1:-1]
    assert abs(centre[m.mean(1).argmax()] - 1000) < 150
    assert kernels.mel_patch(x, SR, 0.0)[:, -1] == pytest.approx(np.log1p(1e-9))


def test_logreg_training_equals_plain_descent(spark):
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(60, 3)), rng.integers(0, 2, 60), rng.choice([1.0, 4.5], 60)
    df = spark.createDataFrame([(a.tolist(), int(b), float(c)) for a, b, c in zip(x, y, w)], "x array<double>, y int, w double")
    got = score.logreg_train(df, "x", "y", "w", epochs=15)
    legs = score.logreg_train(df, "x", "y", "w", epochs=15, leg=4)
    assert np.allclose(legs["weights"], got["weights"], atol=1e-12) and legs["bias"] == pytest.approx(got["bias"], abs=1e-12)
    z = (x - x.mean(0)) / x.std(0)
    v, b = np.zeros(3), 0.0
    for _ in range(15):
        e = (1 / (1 + np.exp(-(z @ v + b))) - y) * w
        v, b = v - 0.1 * (z.T @ e / 60 + 1e-3 * v), b - 0.1 * e.mean()
    assert np.allclose(got["weights"], v) and got["bias"] == pytest.approx(b)
    p = score.logreg_score(df, "x", got).select("score").collect()
    assert np.allclose([r.score for r in p], 1 / (1 + np.exp(-(z @ v + b))))


def wav(x, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(np.repeat((x * (2 ** (8 * width - 1) - 1)).astype({2: "<i2", 4: "<i4"}[width]), channels).tobytes())
    return out.getvalue()


def test_wav_files(spark, tmp_path):
    x = np.sin(np.arange(800) / 20) / 2
    (tmp_path / "a.wav").write_bytes(wav(x))
    (tmp_path / "b-2.wav").write_bytes(wav(x, 4, 2))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    got = {r.clip: r for r in readers.read_wav(spark, str(tmp_path)).collect()}
    assert np.allclose(got["a"].samples, x, atol=1e-3) and np.allclose(got["b-2"].samples, x, atol=1e-3)
    assert got["bad"].samples is None and got["bad"].error
    rate, y = readers.decode_wav(wav(x))
    assert rate == 8000 and len(y) == 800


def test_sidecars_and_splits(spark, tmp_path):
    (tmp_path / "v1cali.txt").write_text("# note\n# shot_detector=cnn\n0.5\n\n1.25\n")
    (tmp_path / "v2cali.txt").write_text("2.0\n1.0\n")
    rows = readers.read_sidecar(spark, str(tmp_path), "cali.txt")
    assert sorted((r.clip, r.t) for r in parse.times_strict(rows).collect()) == [("v1", 0.5), ("v1", 1.25), ("v2", 1.0), ("v2", 2.0)]
    assert [(r.idx, r.t) for r in parse.times_lenient(rows).where("clip = 'v2'").orderBy("idx").collect()] == [(0, 1.0), (1, 2.0)]
    assert {r.clip: r.preamble for r in parse.preamble(rows).collect()} == {"v1": "# note\n# shot_detector=cnn"}
    clips = spark.createDataFrame([("v1-main",), ("v2",)], "clip string")
    assert {(r.clip, r.line) for r in readers.with_prefix_fallback(clips, rows).where("line_no = 0").collect()} == {("v1-main", "# note"), ("v2", "2.0")}
    text = sinks.rewrite_cali(parse.preamble(rows), parse.times_strict(rows)).where("clip = 'v1'").first().text
    assert text == "# note\n# shot_detector=cnn\n0.5000\n1.2500"
    (tmp_path / "split.json").write_text(json.dumps({"note": "n", "train": ["a/t.mp4"], "val": ["b/v.mp4"]}))
    assert {(r.rel_path, r.split) for r in readers.read_split(spark, str(tmp_path / "split.json")).collect()} == {("a/t.mp4", "train"), ("b/v.mp4", "val")}
    files = spark.createDataFrame([("fold", "1.mp4"), ("fold", "2.mp4")], "folder string, name string")
    assert {(r.rel_path, r.split) for r in readers.split_legacy(files).collect()} == {("fold/1.mp4", "train"), ("fold/2.mp4", "val")}
    none = spark.createDataFrame([], "rel_path string, split string")
    assert readers.explicit_or_legacy(none, files).count() == 2
    given = spark.createDataFrame([("fold/1.mp4", "val"), ("gone.mp4", "train")], "rel_path string, split string")
    assert [tuple(r) for r in readers.explicit_or_legacy(given, files).collect()] == [("fold/1.mp4", "val")]
    names = spark.createDataFrame([("S3beep.txt", 0, "4.5"), ("S3beep.txt", 1, "9"), ("7beep.txt", 0, "x")], "name string, line_no int, line string")
    assert [tuple(r) for r in readers.beep_truth(names).collect()] == [("S3-main", 4.5)]


def test_strict_grammar_fails_on_a_bad_line(spark):
    rows = spark.createDataFrame([("a", 0, "1.0"), ("a", 1, "oops")], "clip string, line_no int, line string")
    with pytest.raises(Exception):
        parse.times_strict(rows).collect()
    assert parse.times_lenient(rows).count() == 1


def test_records(spark, tmp_path):
    pooled = spark.createDataFrame([(1, 2)], "tp long, fp long")
    sinks.append_json(sinks.benchmark_record(pooled, "t", "split", {"a": 1}), str(tmp_path / "log"))
    lines = [x for p in (tmp_path / "log").glob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 1
    r = json.loads(lines[0])
    assert r["meta"]["tag"] == "t" and r["meta"]["recorded_utc"].endswith("Z") and r["pooled"]["tp"] == 1 and len(r["meta"]["split_sha256"]) == 16
    d = spark.createDataFrame([("c", 0, 10, 0.5)], "clip string, id long, t long, conf double")
    doc = sinks.events_document(d.select("clip"), d, d.limit(0)).first().document
    assert json.loads(doc)["shots"] == [{"t": 10, "id": 0, "conf": 0.5}]


def test_cached_tables_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    path = str(tmp_path / "t")
    assert readers.cached(spark, path, build).count() == 1
    assert readers.cached(spark, path, build).count() == 1 and len(built) == 1
    assert readers.cached(spark, path, build, rebuild=True).count() == 2


def test_records_and_overrides(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"record_type":"fp","audit_id":"a|FP|0001"}\n{"record_type":"skip","audit_id":null}\n')
    assert [r.audit_id for r in readers.read_manifest(spark, str(tmp_path / "m.jsonl"), "fp").collect()] == ["a|FP|0001"]
    (tmp_path / "o.csv").write_text("\ufeffaudit_id,human_primary\na|FP|0001,echo\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_label_overrides(spark, str(tmp_path / "o.csv")).collect()] == [("a|FP|0001", "echo")]
    files = spark.createDataFrame([(".git", "xcali.txt"), ("b/tmp", "acali.txt"), ("z", "1beep.txt"), ("c/d", "2cali.txt")], "folder string, name string")
    assert readers.annotation_folder(files).first().folder == "c/d"
    labels = spark.createDataFrame([("v", 30, 1)], "clip string, frame long, shot int")
    sure = spark.createDataFrame([("v", 1, True)], "clip string, shot int, motion_confirmed boolean")
    assert sinks.overlay_labels(labels, sure, labels.select("clip")).first().colour == "green"
    ocr = spark.createDataFrame([("9.99 x 1.25 2.5",)], "t string").select(parse.ocr_times(F.col("t"), F.lit(2)).alias("x")).first().x
    assert ocr == [1.25, 2.5]


def test_a_moving_average_holds_a_long_signal_three_times():
    import tracemalloc

    for n, k in itertools.product((1, 2, 3, 7, 50), (1, 2, 3, 4, 9, 60)):
        x = np.random.default_rng(n).normal(size=n)
        before, after = ((k - 1) // 2, (k - 1) // 2) if k % 2 else (k // 2, k // 2 - 1)
        total, i = np.concatenate([[0.0], np.cumsum(x)]), np.arange(n)
        assert (kernels.moving_average(x, k) == (total[np.minimum(i + after + 1, n)] - total[np.maximum(i - before, 0)]) / k).all()
    x = np.ones(1 << 20)
    tracemalloc.start()
    kernels.moving_average(x, 160)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * x.nbytes
