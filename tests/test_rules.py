"""Small cases with known answers, and random ones against plain loops; ties and exact boundaries are common in them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, dedup, matching, metrics
from tidemark.params import micros


def table(spark, rows):
    return spark.createDataFrame([(c, i, int(t), float(x)) for c, i, t, x in rows], "clip string, id long, t long, conf double")


def secs(spark, times, conf=None):
    return table(spark, [("v", i, micros(t), (conf or [1.0] * len(times))[i]) for i, t in enumerate(times)])


CASES = [
    ([1.0, 2.0], [1.01, 2.005], (2, 0, 0)),
    ([1.0, 3.0], [1.0], (1, 0, 1)),
    ([1.0], [1.0, 2.5], (1, 1, 0)),
    ([1.0, 1.02], [1.01], (1, 0, 1)),
]


@pytest.mark.parametrize("refs,dets,want", CASES)
def test_scores(spark, refs, dets, want):
    r, d = secs(spark, refs), secs(spark, dets)
    x = metrics.pooled(metrics.counts(matching.match_greedy_unused(r, d, micros(0.06)), d)).first()
    assert (x.tp, x.fp, x.fn) == want


def test_no_clips_score_zero(spark):
    none = secs(spark, [])
    x = metrics.pooled(metrics.counts(matching.match_greedy_unused(none, none, 60000), none)).first()
    assert (x.clips, x.tp, x.fp, x.fn, x.precision, x.recall, x.f1) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_suppression_keeps_the_better(spark):
    got = dedup.nms_anchored(secs(spark, [0.10, 0.12], [0.5, 0.9]), micros(0.06)).collect()
    assert [r.conf for r in got] == [0.9]
    assert dedup.nms_anchored(secs(spark, []), micros(0.06)).count() == 0
    assert dedup.nms_anchored(secs(spark, [0.1, 0.12]), 0).count() == 2


def test_false_positive_listing(spark):
    got = audit.false_positives(secs(spark, [1.0]), secs(spark, [1.0, 3.0], [0.9, 0.7]), micros(0.06)).collect()
    assert [(r.t, r.conf) for r in got] == [(3_000_000, 0.7)]


def test_double_counts_in_the_metric_but_not_in_the_listing(spark):
    r, d = secs(spark, [1.0]), secs(spark, [1.0, 1.02])
    assert metrics.counts(matching.match_greedy_unused(r, d, 60000), d).first().fp == 1
    assert audit.false_positives(r, d, 60000).count() == 0


def randoms(seed, clips=6, n=30, span=60):
    rng = random.Random(seed)
    return [(f"c{c}", k, rng.randrange(span) * 10, rng.randrange(5) / 4) for c in range(clips) for k in range(rng.randrange(n))]


def by_clip(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def loop_nms(rows, w):
    kept, i = [], 0
    while i < len(rows):
        group = [r for r in rows[i:] if r[2] - rows[i][2] < w]
        kept.append(max(group, key=lambda r: r[3]))
        i += len(group)
    return kept


def loop_last(rows, gap):
    kept = []
    for r in rows:
        if kept and r[2] - kept[-1][2] < gap:
            if r[3] > kept[-1][3]:
                kept[-1] = r
        else:
            kept.append(r)
    return kept


def loop_first(rows, gap):
    kept = []
    for r in rows:
        if not kept or r[2] - kept[-1][2] >= gap:
            kept.append(r)
    return kept


def loop_priority(rows, distance):
    alive = [True] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][3], i), reverse=True):
        if alive[i]:
            for j in range(len(rows)):
                if j != i and abs(rows[j][2] - rows[i][2]) < distance:
                    alive[j] = False
    return [r for r, a in zip(rows, alive) if a]


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_against_loops(spark, seed):
    rows = randoms(seed)
    df = table(spark, rows)
    for op, loop in ((dedup.nms_anchored, loop_nms), (dedup.dedup_last_kept, loop_last), (dedup.thin_keep_first, loop_first), (dedup.suppress_priority, loop_priority)):
        got = sorted((r.clip, r.id) for r in op(df, 40).collect())
        assert got == sorted((r[0], r[1]) for g in by_clip(rows).values() for r in loop(g, 40)), op.__name__


def test_gap_chain_joins_at_the_exact_gap(spark):
    got = {r.id: r.cluster for r in dedup.cluster_gap_chain(table(spark, [("a", 0, 0, 1), ("a", 1, 40, 1), ("a", 2, 81, 1)]), 40).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def loop_match(refs, dets, tol, rule):
    used, out, start = set(), [], 0
    for r in refs:
        best = None
        for j, d in enumerate(dets):
            if (rule == "unused" and j in used) or (rule == "ordered" and j < start):
                continue
            if best is None or abs(d[2] - r[2]) < abs(dets[best][2] - r[2]):
                best = j
        ok = best is not None and abs(dets[best][2] - r[2]) <= tol and not (rule == "check" and best in used)
        if ok:
            used.add(best)
            start = best + 1
        out.append((r[0], r[1], dets[best][1] if ok else None))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_matching_against_loops(spark, seed):
    refs, dets = randoms(seed), randoms(seed + 50)
    r, d = table(spark, refs), table(spark, dets)
    gr, gd = by_clip(refs), by_clip(dets)
    for op, rule in ((matching.match_greedy_unused, "unused"), (matching.match_order_preserving, "ordered"), (matching.match_nearest_then_check, "check")):
        got = sorted(((x.clip, x.ref_id, x.det_id) for x in op(r, d, 20).collect()), key=str)
        want = sorted((y for c in gr for y in loop_match(gr[c], gd.get(c, []), 20, rule)), key=str)
        assert got == want, rule


def test_optimal_matching_against_all_assignments():
    from itertools import permutations

    import numpy as np

    rng = random.Random(5)
    for _ in range(150):
        a = sorted(rng.randrange(20) for _ in range(rng.randrange(1, 5)))
        b = sorted(rng.randrange(20) for _ in range(rng.randrange(0, 5)))
        got = matching.best_assignment(np.array(a), np.array(b), 4)
        assert all(abs(a[i] - b[j]) <= 4 for i, j in got)
        best = (0, 0)
        slots = list(range(len(b))) + [None] * len(a)
        for p in set(permutations(slots, len(a))):
            ok = [(i, j) for i, j in enumerate(p) if j is not None and abs(a[i] - b[j]) <= 4]
            best = max(best, (len(ok), -sum(abs(a[i] - b[j]) for i, j in ok)))
        assert (len(got), -sum(abs(a[i] - b[j]) for i, j in got)) == best


def test_cross_validation_is_strict_and_full(spark):
    a, m = table(spark, [("v", 0, 0, 0.4), ("v", 1, 1000, 0.6)]), table(spark, [("v", 0, 100, 0.8), ("v", 1, 5000, 0.2)])
    got = {(r.audio_id, r.motion_id): r.status for r in matching.cross_validate(a, m, 100, 100).collect()}
    assert got == {(0, None): "audio_only", (1, None): "audio_only", (None, 0): "motion_only", (None, 1): "motion_only"}
    got = {(r.audio_id, r.motion_id): (r.status, r.conf) for r in matching.cross_validate(a, m, 101, 101).collect()}
    assert got[(0, 0)] == ("matched", pytest.approx(0.6))


def test_range_join_gives_each_pair_once(spark):
    rows, other = randoms(7), randoms(8)
    for before, after in ((20, 20), (0, 35), (7, 100)):
        got = sorted((x.clip, x.id, x.r_id) for x in matching.range_join(table(spark, rows), table(spark, other), before, after).collect())
        assert got == sorted((a[0], a[1], b[1]) for a in rows for b in other if a[0] == b[0] and -before <= b[2] - a[2] <= after)


def test_recovery_respects_what_is_there(spark):
    r, d = secs(spark, [1.0, 2.0, 2.01]), secs(spark, [1.0])
    c = table(spark, [("v", 0, micros(2.02), 0.9), ("v", 1, micros(2.04), 0.9), ("v", 2, micros(2.0), 0.1)])
    got = [(x.t, x.recovered) for x in matching.recover_missed(r, d, c, micros(0.06), micros(0.1), 0.15, micros(0.03)).orderBy("t").collect()]
    assert got == [(1_000_000, False), (2_020_000, True)]


def test_offset_scan_finds_the_shift(spark):
    r = secs(spark, [1.0, 2.0, 3.5])
    d = secs(spark, [1.3, 2.3, 3.8])
    best = matching.offset_scan(r, d, micros(0.04), [micros(k / 10) for k in range(-5, 6)]).where("best").first()
    assert (best.offset, best.n) == (300_000, 3)


def test_semi_anti_and_label_at_the_edges(spark):
    rows, other = randoms(9), randoms(10)
    a, b = table(spark, rows), table(spark, other)
    for before, after in ((0, 0), (20, 20), (0, 30), (30, 10)):
        hit = {(x[0], x[1]) for x in rows for y in other if x[0] == y[0] and -before <= y[2] - x[2] <= after}
        assert {(r.clip, r.id) for r in matching.semi(a, b, before, after).collect()} == hit
        assert {(r.clip, r.id) for r in matching.anti(a, b, before, after).collect()} == {(x[0], x[1]) for x in rows} - hit
        assert {(r.clip, r.id) for r in matching.label(a, b, after, before).where("label = 1").collect()} == hit


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12) / 11, rng.randrange(2)) for _ in range(200)]
    got = metrics.auc(spark.createDataFrame(rows, "p double, y int"), "p", "y").first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert got.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    none = metrics.auc(spark.createDataFrame([], "p double, y int"), "p", "y").first()
    assert none.auc == 0.0


@pytest.mark.parametrize("size", [1, 3])
def test_rules_do_not_depend_on_batches(spark, size):
    rows, other = randoms(21, 5, 40), randoms(22, 5, 40)
    a, b = table(spark, rows), table(spark, other)
    ops = {
        "nms": lambda: dedup.nms_anchored(a, 40), "last": lambda: dedup.dedup_last_kept(a, 40), "first": lambda: dedup.thin_keep_first(a, 40), "greedy": lambda: matching.match_greedy_unused(a, b, 20),
        "ordered": lambda: matching.match_order_preserving(a, b, 20), "optimal": lambda: matching.match_optimal(a, b, 20), "recover": lambda: matching.recover_missed(a, b.where("id < 5"), b, 20, 60, 0.1, 30),
    }
    whole = {k: sorted(map(str, f().collect())) for k, f in ops.items()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, size)
    try:
        for k, f in ops.items():
            assert sorted(map(str, f().collect())) == whole[k], k
    finally:
        spark.conf.unset(key)


def test_optimal_matching_against_a_whole_table():
    import numpy as np

    def whole(r, d, tolerance):
        best = {(i, j): (0, 0) for i in range(len(r) + 1) for j in range(len(d) + 1) if not i or not j}
        for i in range(1, len(r) + 1):
            for j in range(1, len(d) + 1):
                best[i, j] = max(best[i - 1, j], best[i, j - 1])
                if abs(r[i - 1] - d[j - 1]) <= tolerance:
                    n, x = best[i - 1, j - 1]
                    best[i, j] = max(best[i, j], (n + 1, x - abs(r[i - 1] - d[j - 1])))
        return best[len(r), len(d)]

    rng = np.random.default_rng(3)
    for _ in range(120):
        r, d = (np.sort(rng.integers(0, 150, rng.integers(0, 45))) for _ in range(2))
        tolerance = int(rng.integers(0, 12))
        got = matching.best_assignment(r, d, tolerance)
        assert all(a < b and c < e for (a, c), (b, e) in zip(got, got[1:]))
        assert all(abs(r[i] - d[j]) <= tolerance for i, j in got)
        assert (len(got), -sum(abs(int(r[i]) - int(d[j])) for i, j in got)) == whole(r.tolist(), d.tolist(), tolerance)


def test_one_busy_clip(spark):
    """A single stretch without gaps, in time linear in its rows."""
    n = 60000
    r = spark.range(n).select(F.lit("a").alias("clip"), "id", (F.col("id") * 10).alias("t"), (F.col("id") % 7 / 7.0).alias("conf"))
    d = r.withColumn("t", F.col("t") + 3)
    assert dedup.dedup_last_kept(r, 25).count() > 1000
    for op in (matching.match_greedy_unused, matching.match_order_preserving, matching.match_optimal):
        assert op(r.select("clip", "id", "t"), d.select("clip", "id", "t"), 12).where("det_id = ref_id").count() == n, op.__name__


def by_dynamic_programming(r, d, tolerance):
    """(pairs, total distance) of the best assignment, by the full table of prefixes."""
    best = [[(0, 0)] * (len(d) + 1) for _ in range(len(r) + 1)]
    for i, x in enumerate(r):
        for j, y in enumerate(d):
            pair = (best[i][j][0] + 1, best[i][j][1] - abs(x - y)) if abs(x - y) <= tolerance else (-1, 0)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], pair)
    return best[-1][-1][0], -best[-1][-1][1]


@pytest.mark.parametrize("seed", range(12))
def test_assignment_decides_as_it_goes(seed):
    """With looks after every few references: the best assignment, each reference once and in order, however dense the rows are."""
    rng = random.Random(seed)
    tolerance, span = rng.choice([(0, 40), (3, 300), (9, 200), (25, 900)])
    r, d = (sorted(rng.randrange(span) for _ in range(n)) for n in (rng.choice([60, 150]), rng.choice([20, 150])))
    for look in (1, 3, 64):
        out = []
        one = matching.Assignment(tolerance, out.append)
        one.LOOK = one.look = look
        for t, is_ref, i in sorted([(t, False, i) for i, t in enumerate(d)] + [(t, True, i) for i, t in enumerate(r)]):
            one.take(t, is_ref, i)
        one.finish()
        assert [x[0] for x in out] == list(range(len(r)))
        pairs = [(r[i], d[j], j) for i, _, j, _ in out if j is not None]
        assert len({j for _, _, j in pairs}) == len(pairs) and all(abs(x - y) <= tolerance for x, y, _ in pairs)
        assert (len(pairs), sum(abs(x - y) for x, y, _ in pairs)) == by_dynamic_programming(r, d, tolerance)


def test_assignment_of_a_long_stretch_holds_little():
    """In a stretch of 40,000 rows without a gap, the table and the detections held stay short."""
    rng = random.Random(1)
    most, out, t = 0, [], 0
    one = matching.Assignment(40, out.append)
    for i in range(40_000):
        t += rng.randrange(1, 30)
        one.take(t, rng.random() < 0.5, i)
        most = max(most, len(one.table) + len(one.dets))
    one.finish()
    assert most < 1000 and len(out) > 15_000
