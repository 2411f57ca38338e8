"""Matching queries: purchases are references, clicks detections, views candidates, errors motion, signups beeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, matching, metrics, search
from tidemark.plans.bind import BEEP, CAND, DET, EV, HOUR, MOTION, REF, role, rounded, timeline

TOL = 4 * HOUR
QUERIES, SQL = {}, {}
RD = f"{EV}, {role('r', REF)}, {role('d', DET)}"
RDC = f"{RD}, {role('c', CAND)}"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _rd(spark, d):
    return timeline(spark, d, REF), timeline(spark, d, DET)


def _walk_refs(refs: str, dets: str, pick: str, free: str, more: str = "") -> str:
    """References of a clip in time order; `free` are the detections that remain, as a list of (t, id)."""
    return f"""o AS (SELECT r.*, row_number() OVER (PARTITION BY clip ORDER BY t, id) AS n FROM {refs} r),
l AS (SELECT o.clip, coalesce(x.ds, []) AS ds FROM (SELECT DISTINCT clip FROM o) o LEFT JOIN (SELECT clip, list({{'t': t, 'id': id}} ORDER BY t, id) AS ds FROM {dets} GROUP BY clip) x ON x.clip = o.clip),
w(clip, n, free, rid, rt, hit) AS (
SELECT clip, 0::BIGINT, ds, NULL::BIGINT, NULL::BIGINT, NULL::STRUCT(t BIGINT, id BIGINT) FROM l UNION ALL
SELECT clip, n, {free}, rid, rt, hit FROM (SELECT w.clip, o.n, w.free, o.id AS rid, o.t AS rt, {pick} AS hit FROM w JOIN o ON o.clip = w.clip AND o.n = w.n + 1){more})"""


def _near(tol: str, op: str = "<=") -> str:
    """The nearest free detection within the tolerance, the first on ties."""
    return f"list_filter(w.free, lambda x: abs(x.t - o.t) {op} {tol} AND abs(x.t - o.t) = list_min(list_transform(w.free, lambda y: abs(y.t - o.t))))[1]"


_UNUSED = "CASE WHEN hit IS NULL THEN free ELSE list_filter(free, lambda x: x.id <> hit.id) END"
_BEHIND = "CASE WHEN hit IS NULL THEN free ELSE list_filter(free, lambda x: x.t > hit.t OR (x.t = hit.t AND x.id > hit.id)) END"
_PAIRS = "SELECT clip, rid AS ref_id, rt AS ref_t, hit.id AS det_id, hit.t AS det_t, abs(hit.t - rt) AS dt FROM w WHERE n > 0"
GREEDY = f"WITH RECURSIVE {RD}, {_walk_refs('r', 'd', _near(str(TOL)), _UNUSED)}"


@query
def match_greedy_unused(spark, d):
    return matching.match_greedy_unused(*_rd(spark, d), TOL)


SQL["match_greedy_unused"] = f"{GREEDY} {_PAIRS}"


@query
def match_nearest_then_check(spark, d):
    return matching.match_nearest_then_check(*_rd(spark, d), TOL)


_NEAREST = f"""p AS (SELECT r.clip, r.id AS rid, r.t AS rt, d.id AS did, d.t AS dt_, abs(d.t - r.t) AS dist FROM r JOIN d ON d.clip = r.clip),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, rid ORDER BY dist, dt_, did) AS k FROM p) WHERE k = 1)"""
_CHECKED = f"{RD}, {_NEAREST}, v AS (SELECT *, row_number() OVER (PARTITION BY clip, did ORDER BY rt, rid) AS turn FROM q WHERE dist <= {TOL})"
SQL["match_nearest_then_check"] = f"WITH {_CHECKED} SELECT r.clip, r.id AS ref_id, r.t AS ref_t, v.did AS det_id, v.dt_ AS det_t, v.dist AS dt FROM r LEFT JOIN v ON v.clip = r.clip AND v.rid = r.id AND v.turn = 1"


@query
def match_order_preserving(spark, d):
    return matching.match_order_preserving(*_rd(spark, d), TOL)


SQL["match_order_preserving"] = f"WITH RECURSIVE {RD}, {_walk_refs('r', 'd', _near(str(TOL)), _BEHIND)} {_PAIRS}"


@query
def match_optimal(spark, d):
    """Pairs and total distance of each clip: unlike the pairs themselves, these are unique."""
    m = matching.match_optimal(*_rd(spark, d), TOL)
    return m.groupBy("clip").agg(F.count("det_id").alias("n"), F.coalesce(F.sum("dt"), F.lit(0)).cast("long").alias("total"))


# the best value over prefixes of references and detections, one reference a step: lists of (pairs x 2^50 - distance)
_BIG = 1 << 50
SQL["match_optimal"] = f"""WITH RECURSIVE {RD}, o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t, id) AS n FROM r),
l AS (SELECT o.clip, coalesce(x.ts, []) AS ts FROM (SELECT DISTINCT clip FROM o) o LEFT JOIN (SELECT clip, list(t ORDER BY t, id) AS ts FROM d GROUP BY clip) x ON x.clip = o.clip),
w(clip, n, ts, best) AS (SELECT clip, 0::BIGINT, ts, list_transform(range(len(ts) + 1), lambda i: 0::BIGINT) FROM l UNION ALL
SELECT clip, n, ts, list_transform(range(1, len(ts) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(best[i], CASE WHEN i > 1 AND abs(ts[i - 1] - t) <= {TOL} THEN best[i - 1] + {_BIG} - abs(ts[i - 1] - t) ELSE 0 END))))
FROM (SELECT w.clip, o.n, w.ts, w.best, o.t FROM w JOIN o ON o.clip = w.clip AND o.n = w.n + 1)),
z AS (SELECT clip, best[len(best)] AS v FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC) AS k FROM w) WHERE k = 1)
SELECT clip, CAST((v + {_BIG - 1}) // {_BIG} AS BIGINT) AS n, CAST(((v + {_BIG - 1}) // {_BIG}) * {_BIG} - v AS BIGINT) AS total FROM z"""


@query
def cross_validate(spark, d):
    out = matching.cross_validate(timeline(spark, d, DET), timeline(spark, d, MOTION), HOUR, TOL)
    return out.withColumn("conf", rounded("conf", 6))


_TOLS = f"g AS (SELECT clip, t - lag(t) OVER (PARTITION BY clip ORDER BY t, side, id) AS gap FROM (SELECT clip, t, id, 0 AS side FROM d UNION ALL SELECT clip, t, id, 1 FROM m)), tol AS (SELECT clip, coalesce(least(greatest(quantile_cont(gap, 0.5) * 0.5, {HOUR}.0), {TOL}.0), {TOL}.0) AS tol FROM g GROUP BY clip), dd AS (SELECT d.*, tol FROM d JOIN tol ON tol.clip = d.clip)"
SQL["cross_validate"] = f"""WITH RECURSIVE {EV}, {role('d', DET)}, {role('m', MOTION)}, {_TOLS}, {_walk_refs('dd', 'm', _near('o.tol', '<'), _UNUSED)}
SELECT coalesce(w.clip, m.clip) AS clip, w.rid AS audio_id, m.id AS motion_id, CASE WHEN w.rid IS NOT NULL AND m.id IS NOT NULL THEN 'matched' WHEN w.rid IS NOT NULL THEN 'audio_only' ELSE 'motion_only' END AS status, round((d.conf + m.conf) / 2, 6) AS conf
FROM (SELECT * FROM w WHERE n > 0) w LEFT JOIN d ON d.clip = w.clip AND d.id = w.rid FULL JOIN m ON m.clip = w.clip AND m.id = w.hit.id"""


@query
def asof_nearest(spark, d):
    return matching.asof_nearest(*_rd(spark, d), TOL).select("clip", "id", F.col("near.id").alias("near_id"), "dt")


SQL["asof_nearest"] = f"WITH {RD}, {_NEAREST} SELECT r.clip, r.id, q.did AS near_id, q.dist AS dt FROM r LEFT JOIN q ON q.clip = r.clip AND q.rid = r.id AND q.dist <= {TOL}"


@query
def asof_backward(spark, d):
    return matching.asof_backward(*_rd(spark, d), strict=True).select("clip", "id", F.col("prev.id").alias("prev_id"), F.col("prev.t").alias("prev_t"))


SQL["asof_backward"] = f"WITH {RD}, q AS (SELECT r.clip, r.id, d.id AS did, d.t AS dt_, row_number() OVER (PARTITION BY r.clip, r.id ORDER BY d.t DESC, d.id) AS k FROM r JOIN d ON d.clip = r.clip AND d.t < r.t) SELECT r.clip, r.id, q.did AS prev_id, q.dt_ AS prev_t FROM r LEFT JOIN q ON q.clip = r.clip AND q.id = r.id AND k = 1"


@query
def range_pairs(spark, d):
    p = matching.range_join(*_rd(spark, d), TOL, TOL)
    return p.select("clip", F.col("id").alias("ref_id"), F.col("r_id").alias("det_id"))


SQL["range_pairs"] = f"WITH {RD} SELECT r.clip, r.id AS ref_id, d.id AS det_id FROM r JOIN d ON d.clip = r.clip AND abs(d.t - r.t) <= {TOL}"


@query
def range_label_semi(spark, d):
    return matching.label(timeline(spark, d, CAND), timeline(spark, d, REF), TOL, TOL).select("clip", "id", "label")


SQL["range_label_semi"] = f"WITH {RDC} SELECT clip, id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.clip = c.clip AND abs(r.t - c.t) <= {TOL}) THEN 1 ELSE 0 END AS label FROM c"


@query
def range_label_asymmetric(spark, d):
    return matching.label(timeline(spark, d, CAND), timeline(spark, d, REF), HOUR, TOL).select("clip", "id", "label")


SQL["range_label_asymmetric"] = f"WITH {RDC} SELECT clip, id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.clip = c.clip AND c.t - r.t BETWEEN {-HOUR} AND {TOL}) THEN 1 ELSE 0 END AS label FROM c"


@query
def range_fp_anti(spark, d):
    return audit.false_positives(*_rd(spark, d), TOL)


_FP = f"fp AS (SELECT d.clip, d.id, d.t, d.conf, coalesce((SELECT min(abs(r.t - d.t)) FROM r WHERE r.clip = d.clip), {audit.FAR}) AS distance FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.clip = d.clip AND abs(r.t - d.t) <= {TOL}))"
SQL["range_fp_anti"] = f"WITH {RD}, {_FP} SELECT * FROM fp"


@query
def range_overlap(spark, d):
    return matching.overlaps(*_rd(spark, d))


SQL["range_overlap"] = f"WITH {RD}, x AS (SELECT clip, min(t) AS a, max(t) AS b FROM r GROUP BY clip), y AS (SELECT clip, min(t) AS a, max(t) AS b FROM d GROUP BY clip) SELECT x.clip, coalesce(x.b >= y.a AND x.a <= y.b, false) AS overlap FROM x LEFT JOIN y ON y.clip = x.clip"


@query
def recover_missed(spark, d):
    r, x = _rd(spark, d)
    return matching.recover_missed(r, x, timeline(spark, d, CAND), TOL, 6 * HOUR, 60.0, 2 * HOUR)


SQL["recover_missed"] = f"""WITH RECURSIVE {RDC}, miss AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.clip = r.clip AND abs(d.t - r.t) <= {TOL})),
best AS (SELECT * FROM (SELECT miss.clip, miss.t AS rt, miss.id AS rid, c.id, c.t, c.conf, row_number() OVER (PARTITION BY miss.clip, miss.id ORDER BY abs(c.t - miss.t), c.t, c.id) AS k FROM miss JOIN c ON c.clip = miss.clip AND abs(c.t - miss.t) <= {6 * HOUR} AND c.conf >= 60) WHERE k = 1),
ok AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY rt, rid) AS n FROM best WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.clip = best.clip AND abs(d.t - best.t) <= {2 * HOUR})),
w(clip, n, kept, id, t, conf, here) AS (SELECT clip, n, [t], id, t, conf, true FROM ok WHERE n = 1 UNION ALL
SELECT ok.clip, ok.n, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - ok.t) <= {2 * HOUR})) = 0 THEN list_append(w.kept, ok.t) ELSE w.kept END, ok.id, ok.t, ok.conf, len(list_filter(w.kept, lambda x: abs(x - ok.t) <= {2 * HOUR})) = 0 FROM w JOIN ok ON ok.clip = w.clip AND ok.n = w.n + 1)
SELECT clip, id, t, conf, false AS recovered FROM d UNION ALL SELECT clip, id, t, conf, true FROM w WHERE here"""


@query
def fn_diagnosis(spark, d):
    r, x = _rd(spark, d)
    return audit.false_negatives(r, x, timeline(spark, d, CAND), TOL)


def _any(name: str, of: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT r.clip, r.id, {of}.t AS nt, abs({of}.t - r.t) AS nd, {of}.conf AS nc, row_number() OVER (PARTITION BY r.clip, r.id ORDER BY abs({of}.t - r.t), {of}.t, {of}.id) AS k FROM r JOIN {of} ON {of}.clip = r.clip) WHERE k = 1)"


_FN = f"""WITH RECURSIVE {RDC}, {_walk_refs('r', 'd', _near(str(TOL)), _UNUSED)}, {_any('nd', 'd')}, {_any('nc', 'c')}, gp AS (SELECT clip, id, t, t - lag(t) OVER (PARTITION BY clip ORDER BY t, id) AS gap FROM r),
fn AS (SELECT gp.clip, gp.id, gp.t, gp.gap, gp.gap IS NULL AS is_first, nd.nt AS det_t, nd.nd AS det_dt, nc.nt AS cand_t, nc.nd AS cand_dt, nc.nc AS cand_conf
FROM w JOIN gp ON gp.clip = w.clip AND gp.id = w.rid LEFT JOIN nd ON nd.clip = gp.clip AND nd.id = gp.id LEFT JOIN nc ON nc.clip = gp.clip AND nc.id = gp.id WHERE w.n > 0 AND w.hit IS NULL)"""
SQL["fn_diagnosis"] = f"{_FN} SELECT * FROM fn"


@query
def fp_hints(spark, d):
    r, x = _rd(spark, d)
    beep = timeline(spark, d, BEEP).groupBy("clip").agg(F.min("t").alias("t"))
    return audit.fp_hints(audit.false_positives(r, x, TOL), r, beep, TOL, 12 * HOUR).select("clip", "id", "distance", "prev_ref", "echo", "since_beep")


SQL["fp_hints"] = f"""WITH {RD}, {role('b', BEEP)}, {_FP}, x AS (SELECT fp.*, (SELECT max(r.t) FROM r WHERE r.clip = fp.clip AND r.t < fp.t) AS prev_ref, (SELECT min(b.t) FROM b WHERE b.clip = fp.clip) AS beep FROM fp)
SELECT clip, id, distance, prev_ref, coalesce(t - prev_ref > 0 AND t - prev_ref < {12 * HOUR}, false) AND distance > {TOL} AS echo, t - beep AS since_beep FROM x"""


@query
def fn_hints(spark, d):
    r, x = _rd(spark, d)
    fn = audit.false_negatives(r, x, timeline(spark, d, CAND), TOL)
    return audit.fn_hints(fn, 24 * HOUR, 8 * HOUR, 100.0, 6 * HOUR).select("clip", "id", "might_fast_follow", "might_classifier_reject", "might_no_stage1")


SQL["fn_hints"] = f"{_FN} SELECT clip, id, coalesce(gap < {24 * HOUR}, false) AS might_fast_follow, coalesce(cand_dt <= {8 * HOUR} AND cand_conf < 100, false) AS might_classifier_reject, cand_dt IS NULL OR cand_dt > {6 * HOUR} AS might_no_stage1 FROM fn"


@query
def error_manifest(spark, d):
    r, x = _rd(spark, d)
    fn = audit.false_negatives(r, x, timeline(spark, d, CAND), TOL)
    return audit.manifest(audit.false_positives(r, x, TOL), fn).select("record_type", "audit_id", "clip", "t", "conf", "distance")


SQL["error_manifest"] = f"""{_FN}, {_FP}, a AS (SELECT 'fp' AS record_type, clip, id, t, conf, distance, row_number() OVER (ORDER BY clip, t, id) AS n FROM fp UNION ALL SELECT 'fn', clip, id, t, NULL, det_dt, row_number() OVER (ORDER BY clip, t, id) FROM fn)
SELECT record_type, format('{{}}|{{}}|{{:04d}}', clip, upper(record_type), n) AS audit_id, clip, t, conf, distance FROM a"""


@query
def candidate_coverage(spark, d):
    return audit.candidate_coverage(timeline(spark, d, REF), timeline(spark, d, CAND), TOL)


SQL["candidate_coverage"] = f"WITH {RDC} SELECT clip, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM c WHERE c.clip = r.clip AND abs(c.t - r.t) <= {TOL})) AS covered FROM r GROUP BY clip"


@query
def window_argmax(spark, d):
    e = timeline(spark, d).withColumnRenamed("conf", "value")
    return matching.window_argmax(timeline(spark, d, REF), e, 2 * HOUR, 8 * HOUR)


_WIN = f"{EV}, {role('r', REF)}, p AS (SELECT r.clip, r.id AS ref_id, r.t AS ref_t, ev.id, ev.t, ev.conf AS v FROM r JOIN ev ON ev.clip = r.clip AND ev.t BETWEEN r.t - {2 * HOUR} AND r.t + {8 * HOUR}), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, ref_id ORDER BY v DESC, t, id) AS n FROM p) WHERE n = 1)"
SQL["window_argmax"] = f"WITH {_WIN} SELECT clip, ref_id, ref_t, id AS peak_id, t AS peak_t, v AS peak_value FROM k"


@query
def window_stats(spark, d):
    e = timeline(spark, d).withColumnRenamed("conf", "value")
    s = matching.window_stats(timeline(spark, d, REF), e, 2 * HOUR, 8 * HOUR)
    # the operator has no ratio to a mean that isn't above 0; SQL has one, and none for 0 by 0 only
    none = F.when(F.col("peak_value") == 0, F.lit(float("nan"))).when(F.col("peak_value") > 0, F.lit(float("inf")))
    s = s.withColumn("peak_to_mean", F.when(F.col("mean") == 0, none).otherwise(F.try_divide("peak_value", "mean")))
    return s.select("clip", "ref_id", "peak_t", "low", "high", "n", "rise", "fall", "offset", *[rounded(c, 5).alias(c) for c in ("mean", "std", "before_peak", "after_peak", "peak_to_mean", "ratio")])


SQL["window_stats"] = f"""WITH {_WIN} SELECT p.clip, p.ref_id, k.t AS peak_t, min(p.v) AS low, max(p.v) AS high, count(*) AS n, k.t - (k.ref_t - {2 * HOUR}) AS rise, k.ref_t + {8 * HOUR} - k.t AS fall, k.t - k.ref_t AS offset,
round(avg(p.v), 5) AS mean, round(stddev_pop(p.v), 5) AS std, round(avg(p.v) FILTER (WHERE (p.t, p.id) <= (k.t, k.id)), 5) AS before_peak, round(avg(p.v) FILTER (WHERE (p.t, p.id) >= (k.t, k.id)), 5) AS after_peak, round(k.v / avg(p.v), 5) AS peak_to_mean,
round(avg(p.v) FILTER (WHERE (p.t, p.id) >= (k.t, k.id)) / (avg(p.v) FILTER (WHERE (p.t, p.id) <= (k.t, k.id)) + 1e-9), 5) AS ratio
FROM p JOIN k ON k.clip = p.clip AND k.ref_id = p.ref_id GROUP BY p.clip, p.ref_id, k.t, k.ref_t, k.v"""

OFFSETS = [HOUR * k for k in range(-5, 6)]


@query
def ref_offset_scan(spark, d):
    return matching.offset_scan(*_rd(spark, d), TOL, OFFSETS).select("clip", F.col("offset").alias("moved"), "n", rounded("mae", 3).alias("mae"), "best")


_OFF = f"{RD}, f AS (SELECT unnest({OFFSETS!r})::BIGINT AS moved), ro AS (SELECT {{'c': r.clip, 'o': moved}} AS clip, id, t + moved AS t, conf FROM r, f), dx AS (SELECT {{'c': d.clip, 'o': moved}} AS clip, id, t, conf FROM d, f)"
SQL["ref_offset_scan"] = f"""WITH RECURSIVE {_OFF}, {_walk_refs('ro', 'dx', _near(str(TOL)), _BEHIND)}, g AS (SELECT clip, count(hit) AS n, avg(abs(hit.t - rt)) AS mae FROM w WHERE n > 0 GROUP BY clip)
SELECT clip.c AS clip, clip.o AS moved, n, round(mae, 3) AS mae, row_number() OVER (PARTITION BY clip.c ORDER BY n DESC, mae ASC NULLS LAST, clip.o) = 1 AS best FROM g"""

THRESHOLDS = [25.0 * k for k in range(1, 10)]


@query
def threshold_sweep(spark, d):
    out = search.threshold_sweep(*_rd(spark, d), TOL, THRESHOLDS)
    return out.select("threshold", "n_gt", "n_det", "tp", "fp", "fn", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")], "best")


_PRF = "n_gt, n_det, tp, n_det - tp AS fp, n_gt - tp AS fn, CASE WHEN n_det = 0 THEN 0.0 ELSE tp / n_det END AS p, CASE WHEN n_gt = 0 THEN 0.0 ELSE tp / n_gt END AS rc"
_OUT = "n_gt, n_det, tp, fp, fn, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc = 0 THEN 0.0 ELSE 2 * p * rc / (p + rc) END, 6) AS f1"
_F1 = "CASE WHEN p + rc = 0 THEN 0.0 ELSE 2 * p * rc / (p + rc) END"
SQL["threshold_sweep"] = f"""WITH {RD}, th AS (SELECT unnest({THRESHOLDS!r})::DOUBLE AS threshold), dd AS (SELECT threshold, d.* FROM d JOIN th ON conf >= threshold), p AS (SELECT threshold, r.clip, r.id AS rid, r.t AS rt, dd.id AS did, dd.t AS dt_, abs(dd.t - r.t) AS dist FROM r JOIN dd ON dd.clip = r.clip),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY threshold, clip, rid ORDER BY dist, dt_, did) AS k FROM p) WHERE k = 1 AND dist <= {TOL}),
z AS (SELECT threshold, (SELECT count(*) FROM r) AS n_gt, (SELECT count(*) FROM dd WHERE dd.threshold = th.threshold) AS n_det, (SELECT count(DISTINCT (clip, did)) FROM q WHERE q.threshold = th.threshold) AS tp FROM th), y AS (SELECT threshold, {_PRF} FROM z)
SELECT threshold, {_OUT}, row_number() OVER (ORDER BY {_F1} DESC, threshold) = 1 AS best FROM y"""

#: Seven confidences by four windows.
GRID, WINDOWS = [25.0 * k for k in range(1, 8)], [0, HOUR, 6 * HOUR, 12 * HOUR]
#: Fourteen thresholds.
ENERGIES = [10.0 * k for k in range(1, 11)] + [125.0, 150.0, 175.0, 200.0]


@query
def grid_search(spark, d):
    out = search.grid_search(*_rd(spark, d), TOL, GRID, WINDOWS)
    return out.select("threshold", F.col("window").alias("nms_window"), "n_gt", "n_det", "tp", "fp", "fn", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")], "best")


SQL["grid_search"] = f"""WITH RECURSIVE {RD}, th AS (SELECT threshold, win FROM (SELECT unnest({GRID!r})::DOUBLE AS threshold), (SELECT unnest({WINDOWS!r})::BIGINT AS win)),
o AS (SELECT threshold, win, d.*, row_number() OVER (PARTITION BY threshold, win, clip ORDER BY t, id) AS n FROM d JOIN th ON conf >= threshold),
w(threshold, win, clip, n, id, t, conf, anchor, grp) AS (SELECT threshold, win, clip, n, id, t, conf, t, 1 FROM o WHERE n = 1 UNION ALL
SELECT o.threshold, o.win, o.clip, o.n, o.id, o.t, o.conf, CASE WHEN o.t - w.anchor < o.win THEN w.anchor ELSE o.t END, CASE WHEN o.t - w.anchor < o.win THEN w.grp ELSE w.grp + 1 END FROM w JOIN o ON o.clip = w.clip AND o.n = w.n + 1 AND o.threshold = w.threshold AND o.win = w.win),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY threshold, win, clip, grp ORDER BY conf DESC, n) AS k FROM w) WHERE k = 1),
p AS (SELECT threshold, win, r.clip, r.id AS rid, dd.id AS did, dd.t AS dt_, abs(dd.t - r.t) AS dist FROM r JOIN dd ON dd.clip = r.clip),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY threshold, win, clip, rid ORDER BY dist, dt_, did) AS kk FROM p) WHERE kk = 1 AND dist <= {TOL}),
z AS (SELECT threshold, win, (SELECT count(*) FROM r) AS n_gt, (SELECT count(*) FROM dd WHERE dd.threshold = th.threshold AND dd.win = th.win) AS n_det, (SELECT count(DISTINCT (clip, did)) FROM q WHERE q.threshold = th.threshold AND q.win = th.win) AS tp FROM th), y AS (SELECT threshold, win, {_PRF} FROM z)
SELECT threshold, win AS nms_window, {_OUT}, row_number() OVER (ORDER BY {_F1} DESC, threshold, win) = 1 AS best FROM y"""


@query
def energy_sweep(spark, d):
    out = search.energy_sweep(*_rd(spark, d), [TOL, 12 * HOUR], ENERGIES, 0.5)
    return out.select("tolerance", "threshold", "n_gt", "n_det", "tp", "fp", "fn", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")], "first")


def _sweep(tol: int) -> str:
    return f"""(WITH RECURSIVE {RD}, th AS (SELECT unnest({ENERGIES!r})::DOUBLE AS threshold), rx AS (SELECT {{'c': clip, 'h': threshold}} AS clip, id, t, conf FROM r, th), dx AS (SELECT {{'c': clip, 'h': threshold}} AS clip, id, t, conf FROM d JOIN th ON conf >= threshold),
{_walk_refs('rx', 'dx', _near(str(tol)), _UNUSED)}, z AS (SELECT threshold, (SELECT count(*) FROM r) AS n_gt, (SELECT count(*) FROM dx WHERE dx.clip.h = threshold) AS n_det, (SELECT count(hit) FROM w WHERE w.clip.h = threshold) AS tp FROM th) SELECT {tol}::BIGINT AS tolerance, threshold, {_PRF} FROM z)"""


SQL["energy_sweep"] = f"""SELECT tolerance, threshold, {_OUT}, rc >= 0.5 AND row_number() OVER (ORDER BY rc >= 0.5 DESC, tolerance, threshold DESC) = 1 AS first FROM (SELECT * FROM {_sweep(TOL)} UNION ALL SELECT * FROM {_sweep(12 * HOUR)})"""


@query
def prf_per_clip(spark, d):
    """Detections after suppression against references: scores of each clip."""
    from tidemark.operators import dedup

    r, x = _rd(spark, d)
    kept = dedup.nms_anchored(x, HOUR)
    m = matching.match_greedy_unused(r, kept, TOL)
    out = metrics.with_prf(metrics.counts(m, kept))
    return out.select("clip", "n_gt", "n_det", "tp", "fp", "fn", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_KEPT = f"""od AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t, id) AS n FROM d), wd(clip, n, id, t, conf, anchor, grp) AS (SELECT clip, n, id, t, conf, t, 1 FROM od WHERE n = 1 UNION ALL
SELECT od.clip, od.n, od.id, od.t, od.conf, CASE WHEN od.t - wd.anchor < {HOUR} THEN wd.anchor ELSE od.t END, CASE WHEN od.t - wd.anchor < {HOUR} THEN wd.grp ELSE wd.grp + 1 END FROM wd JOIN od ON od.clip = wd.clip AND od.n = wd.n + 1),
kd AS (SELECT clip, id, t, conf FROM (SELECT *, row_number() OVER (PARTITION BY clip, grp ORDER BY conf DESC, n) AS k FROM wd) WHERE k = 1)"""
_SCORED = f"""WITH RECURSIVE {RD}, {_KEPT}, {_walk_refs('r', 'kd', _near(str(TOL)), _UNUSED)}, a AS (SELECT clip, count(*) AS n_gt, count(hit) AS tp FROM w WHERE n > 0 GROUP BY clip), b AS (SELECT clip, count(*) AS n_det FROM kd GROUP BY clip),
z AS (SELECT coalesce(a.clip, b.clip) AS clip, coalesce(n_gt, 0) AS n_gt, coalesce(n_det, 0) AS n_det, coalesce(tp, 0) AS tp FROM a FULL JOIN b ON b.clip = a.clip)"""
SQL["prf_per_clip"] = f"{_SCORED}, y AS (SELECT clip, {_PRF} FROM z) SELECT clip, {_OUT} FROM y"


@query
def prf_pooled(spark, d):
    from tidemark.operators import dedup

    r, x = _rd(spark, d)
    kept = dedup.nms_anchored(x, HOUR)
    out = metrics.pooled(metrics.counts(matching.match_greedy_unused(r, kept, TOL), kept))
    return out.select("clips", "n_gt", "n_det", "tp", "fp", "fn", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


SQL["prf_pooled"] = f"{_SCORED}, s AS (SELECT count(*) AS clips, CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(n_det) AS BIGINT) AS n_det, CAST(sum(tp) AS BIGINT) AS tp FROM z), y AS (SELECT clips, {_PRF} FROM s) SELECT clips, {_OUT} FROM y"


@query
def frame_labels(spark, d):
    return matching.frame_labels(timeline(spark, d, DET), 1 / 86400)


SQL["frame_labels"] = f"WITH {EV}, {role('d', DET)}, n AS (SELECT clip, t, row_number() OVER (PARTITION BY clip ORDER BY t, id) AS shot FROM d) SELECT clip, CAST(floor(t * {1 / 86400!r} / 1000000.0) AS BIGINT) AS frame, max(shot) AS shot FROM n GROUP BY 1, 2"


@query
def motion_confirmed(spark, d):
    """Detections with whether a motion row is within the tolerance; then the strict and the balanced filter's verdicts."""
    x = matching.label(timeline(spark, d, DET), timeline(spark, d, MOTION), TOL, TOL)
    sure = F.col("label") == 1
    return x.select("clip", "id", sure.alias("motion_confirmed"), sure.alias("strict"), (sure | (F.col("conf") >= 45.0)).alias("balanced"))


SQL["motion_confirmed"] = f"WITH {EV}, {role('d', DET)}, {role('m', MOTION)}, x AS (SELECT clip, id, conf, EXISTS (SELECT 1 FROM m WHERE m.clip = d.clip AND abs(m.t - d.t) <= {TOL}) AS ok FROM d) SELECT clip, id, ok AS motion_confirmed, ok AS strict, ok OR conf >= 45.0 AS balanced FROM x"
