"""Clips come from Arrow batches a few at a time."""

import numpy as np
import pandas as pd
import pyarrow as pa

from tidemark.operators import detect
from tidemark.params import Beep
from tidemark.plans import q_signal

SF = "/root/testdata/sf0.001"


def test_a_batch_is_python_values_a_few_clips_at_a_time(monkeypatch):
    seen = []
    cells = detect._cells
    monkeypatch.setattr(detect, "_cells", lambda column: seen.append(len(column)) or cells(column))
    x = pa.array([[1.0, None], [], None, [3.0]] * 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), x, pa.array([[{"t": 1}]] * 200)], names=["clip", "samples", "marks"])
    rows = list(detect._clips(iter([batch, batch.slice(3, 5)])))
    assert len(rows) == 205 and max(seen) == detect.CLIPS
    assert [r[0] for r in rows] == [*range(200), *range(3, 8)]
    assert all(isinstance(r[1], np.ndarray) or r[1] is None for r in rows) and rows[2][1] is None and rows[2][2] == [{"t": 1}]
    assert np.isnan(rows[0][1][1]) and rows[0][1][0] == 1.0 and rows[200][1].tolist() == [3.0] and not len(rows[1][1])


def test_settings_that_share_an_envelope_look_for_its_peaks_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(detect, "_each", lambda kernel, *a, **k: kept.append(kernel))
    grid = [Beep(height_share=h) for h in (0.25, 0.35, 0.55)] + [Beep(deviations=1.0)]
    detect.beep_grid(None, grid)
    row = q_signal._sounds(spark, SF).orderBy("clip").first()
    x = q_signal._sound(row.samples)
    calls = []
    peaks = detect._beep_peaks
    monkeypatch.setattr(detect, "_beep_peaks", lambda *a: calls.append(1) or peaks(*a))
    got = kept[0]("a", row.sr, x)
    assert len(calls) == 2
    alone = [detect._one_beep(x, row.sr, p, detect._beep_envelope(x, row.sr, p), None) for p in grid]
    assert isinstance(got, pd.DataFrame) and got["t"].tolist() == [detect._reported(t) for t in alone if t is not None]
