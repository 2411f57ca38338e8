"""The sweeps against plain loops, one setting at a time, on times with ties and equal distances."""

import random

import pytest

from tidemark.operators import search


def suppressed(dets, window):
    """Anchored: a cluster is what is less than the window after its first row; the most confident stays, the first on ties."""
    out, anchor = [], None
    for d in dets:
        if window > 0 and anchor is not None and d[0] - anchor < window:
            if d[2] > out[-1][2]:
                out[-1] = d
        else:
            anchor = d[0]
            out.append(d)
    return out


def nearest_then_check(refs, dets, tolerance):
    used = set()
    for t, _ in refs:
        best = min(dets, key=lambda d: (abs(d[0] - t), d[0], d[1]), default=None)
        if best is not None and abs(best[0] - t) <= tolerance:
            used.add(best)
    return len(used)


def greedy(refs, dets, tolerance):
    free = list(dets)
    for t, _ in refs:
        best = min(free, key=lambda d: (abs(d[0] - t), d[0], d[1]), default=None)
        if best is not None and abs(best[0] - t) <= tolerance:
            free.remove(best)
    return len(dets) - len(free)


@pytest.mark.parametrize("seed", range(4))
def test_sweeps(spark, seed, monkeypatch):
    monkeypatch.setattr(search, "LOOK", 3)  # so that references are settled between rows
    rng = random.Random(seed)
    clips = {}
    for c in range(6):
        span = rng.choice([10, 60, 400])
        refs = sorted((rng.randrange(span), i) for i in range(rng.choice([0, 1, 25])))
        dets = sorted((rng.randrange(span), i, float(rng.randrange(6))) for i in range(rng.choice([0, 1, 40])))
        clips[c] = refs, dets
    r = spark.createDataFrame([(c, i, t) for c, (refs, _) in clips.items() for t, i in refs], "clip long, id long, t long")
    d = spark.createDataFrame([(c, i, t, v) for c, (_, dets) in clips.items() for t, i, v in dets], "clip long, id long, t long, conf double")
    n_gt = sum(len(refs) for refs, _ in clips.values())
    for row in search.grid_search(r, d, 4, [0.0, 2.0, 4.0, 9.0], [0, 1, 5, 30]).collect():
        kept = {c: suppressed([x for x in dets if x[2] >= row.threshold], row.window) for c, (_, dets) in clips.items()}
        want = sum(nearest_then_check(refs, kept[c], 4) for c, (refs, _) in clips.items())
        assert (row.n_gt, row.n_det, row.tp) == (n_gt, sum(map(len, kept.values())), want), (row.threshold, row.window)
    for row in search.energy_sweep(r, d, [0, 3, 12], [0.0, 1.0, 3.0, 5.0, 9.0], 0.3).collect():
        kept = {c: [x for x in dets if x[2] >= row.threshold] for c, (_, dets) in clips.items()}
        want = sum(greedy(refs, kept[c], row.tolerance) for c, (refs, _) in clips.items())
        assert (row.n_gt, row.n_det, row.tp) == (n_gt, sum(map(len, kept.values())), want)
    best = [x.threshold for x in search.threshold_sweep(r, d, 4, [0.0, 2.0, 4.0, 9.0]).collect() if x.best]
    assert len(best) == 1
