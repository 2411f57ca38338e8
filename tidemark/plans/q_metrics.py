"""Metrics, scores and training queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import logit_score
from tidemark.operators import audit, matching, metrics, score, search
from tidemark.plans.bind import BEEP, CAND, DET, EV, HOUR, REF, read, role, rounded, timeline
from tidemark.plans.q_match import _CHECKED, _FP, RD, TOL

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def skip_accounting(spark, d):
    clips = timeline(spark, d).select("clip").distinct()
    return metrics.skip_accounting(clips, timeline(spark, d, REF), timeline(spark, d, BEEP))


SQL["skip_accounting"] = f"WITH {EV}, x AS (SELECT clip, min(t) FILTER (WHERE kind = '{BEEP}') AS b, max(t) FILTER (WHERE kind = '{REF}') AS r FROM ev GROUP BY clip) SELECT CASE WHEN b IS NULL THEN 'no_beep' WHEN r IS NULL THEN 'no_ref' WHEN r < b THEN 'no_ref_after_beep' ELSE 'used' END AS reason, count(*) AS n FROM x GROUP BY 1"


@query
def fp_bands(spark, d):
    fp = audit.false_positives(timeline(spark, d, REF), timeline(spark, d, DET), TOL)
    return metrics.fp_bands(fp, 200.0, 50.0).withColumn("mean", rounded("mean", 6))


SQL["fp_bands"] = f"WITH {RD}, {_FP} SELECT CASE WHEN conf > 200 THEN 'high' WHEN conf >= 50 THEN 'middle' ELSE 'low' END AS band, count(*) AS n, min(conf) AS least, max(conf) AS most, round(avg(conf), 6) AS mean FROM fp GROUP BY 1"


@query
def mae_rmse(spark, d):
    m = matching.match_nearest_then_check(timeline(spark, d, REF), timeline(spark, d, DET), TOL)
    out = metrics.errors(m, HOUR)
    return out.select("n", rounded("mae", 2).alias("mae"), rounded("rmse", 2).alias("rmse"), "most", "failures")


_M = f"{_CHECKED}, m AS (SELECT r.clip, v.dist AS dt FROM r LEFT JOIN v ON v.clip = r.clip AND v.rid = r.id AND v.turn = 1)"
SQL["mae_rmse"] = f"WITH {_M} SELECT count(dt) AS n, round(avg(dt), 2) AS mae, round(sqrt(avg(dt::DOUBLE * dt)), 2) AS rmse, max(dt) AS most, count(*) FILTER (WHERE dt IS NULL OR dt >= {HOUR}) AS failures FROM m"


@query
def weighted_mae(spark, d):
    m = matching.match_nearest_then_check(timeline(spark, d, REF), timeline(spark, d, DET), TOL)
    per = m.groupBy("clip").agg(F.count("dt").alias("n"), F.avg("dt").alias("mae"))
    return metrics.weighted_mae(per).select("n", rounded("mae", 2).alias("mae"))


SQL["weighted_mae"] = f"WITH {_M}, g AS (SELECT clip, count(dt) AS n, avg(dt) AS mae FROM m GROUP BY clip) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * mae) / sum(n) FILTER (WHERE mae IS NOT NULL), 2) AS mae FROM g"


@query
def quantile_nearest_rank(spark, d):
    return metrics.quantiles_nearest_rank(timeline(spark, d, DET), "conf").withColumn("n", F.col("n").cast("long"))


SQL["quantile_nearest_rank"] = f"WITH {EV}, {role('d', DET)}, g AS (SELECT clip, list(conf ORDER BY conf) AS xs, count(*) AS n FROM d GROUP BY clip) SELECT clip, n, xs[1] AS least, xs[CAST(round_even(0.1 * (n - 1), 0) AS INT) + 1] AS p10, xs[n // 2 + 1] AS p50, xs[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] AS p90, xs[n] AS most FROM g"


@query
def quantile_linear(spark, d):
    qs = (0.3, 0.75, 0.9, 0.92, 0.95, 0.995)
    out = metrics.quantiles_linear(timeline(spark, d), "conf", qs)
    return out.select("clip", *[rounded(c, 6).alias(c) for c in out.columns[1:]])


SQL["quantile_linear"] = f"WITH {EV} SELECT clip, " + ", ".join(f"round(quantile_cont(conf, {q}), 6) AS p{round(q * 1000)}" for q in (0.3, 0.75, 0.9, 0.92, 0.95, 0.995)) + " FROM ev GROUP BY clip"


@query
def robust_z(spark, d):
    return metrics.robust_z(timeline(spark, d, DET), "conf").select("clip", "id", rounded("z", 6).alias("z"))


SQL["robust_z"] = f"WITH {EV}, {role('d', DET)}, a AS (SELECT clip, quantile_cont(conf, 0.5) AS med FROM d GROUP BY clip), b AS (SELECT d.clip, quantile_cont(abs(conf - med), 0.5) AS mad FROM d JOIN a ON a.clip = d.clip GROUP BY d.clip) SELECT d.clip, d.id, round((conf - med) / ((mad + 1e-9) * 1.4826 + 1e-9), 6) AS z FROM d JOIN a ON a.clip = d.clip JOIN b ON b.clip = d.clip"


@query
def moments(spark, d):
    out = metrics.moments(timeline(spark, d), "conf")
    return out.select("clip", "n", rounded("mean", 6).alias("mean"), rounded("std", 6).alias("std"), "least", "most", rounded("median", 6).alias("median"))


SQL["moments"] = f"WITH {EV} SELECT clip, count(*) AS n, round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std, min(conf) AS least, max(conf) AS most, round(quantile_cont(conf, 0.5), 6) AS median FROM ev GROUP BY clip"


@query
def pareto(spark, d):
    out = metrics.pareto(read(spark, d, "documents"), "source")
    return out.select("label", "n", F.col("rank").cast("long").alias("rank"), rounded("pct", 6).alias("pct"), rounded("cum_pct", 6).alias("cum_pct"), "within")


SQL["pareto"] = "WITH g AS (SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), x AS (SELECT *, row_number() OVER w AS rank, sum(n) OVER w AS run, sum(n) OVER () AS total FROM g WINDOW w AS (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING)) SELECT label, n, rank, round(100.0 * n / total, 6) AS pct, round(100.0 * run / total, 6) AS cum_pct, run - n < 0.8 * total AS within FROM (SELECT label, n, rank, run::DOUBLE AS run, total::DOUBLE AS total FROM x)"


@query
def dataset_counts(spark, d):
    clips = timeline(spark, d).select("clip").distinct()
    out = metrics.dataset_counts(clips, timeline(spark, d, DET), timeline(spark, d, BEEP))
    return out.select("clips", "shots", "beeps", rounded("shots_per_clip", 6).alias("shots_per_clip"), "without_shots", "without_beep")


SQL["dataset_counts"] = f"WITH {EV}, g AS (SELECT clip, count(*) FILTER (WHERE kind = '{DET}') AS s, count(*) FILTER (WHERE kind = '{BEEP}') AS b FROM ev GROUP BY clip) SELECT count(*) AS clips, CAST(sum(s) AS BIGINT) AS shots, CAST(sum(b) AS BIGINT) AS beeps, round(avg(s), 6) AS shots_per_clip, count(*) FILTER (WHERE s = 0) AS without_shots, count(*) FILTER (WHERE b = 0) AS without_beep FROM g"


@query
def class_means(spark, d):
    e = read(spark, d, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    out = metrics.class_means(e, "embedding", "y")
    return out.select("i", *[rounded(c, 6).alias(c) for c in ("pos", "neg", "diff")])


SQL["class_means"] = "WITH x AS (SELECT unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v, label < 5 AS y FROM embeddings), g AS (SELECT i, avg(v) FILTER (WHERE y) AS pos, avg(v) FILTER (WHERE NOT y) AS neg FROM x GROUP BY i) SELECT CAST(i AS INT) AS i, round(pos, 6) AS pos, round(neg, 6) AS neg, round(pos - neg, 6) AS diff FROM g"


@query
def auc(spark, d):
    x = timeline(spark, d, CAND).select((F.round("conf", 0) / 500).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = metrics.auc(x, "p", "y")
    return out.select("pos", "neg", *[rounded(c, 9).alias(c) for c in ("auc", "precision", "recall", "f1")])


SQL["auc"] = f"""WITH {EV}, x AS (SELECT round(conf, 0) / 500 AS p, id % 3 = 0 AS y FROM ev WHERE kind = '{CAND}'), g AS (SELECT p, count(*) FILTER (WHERE y) AS a, count(*) FILTER (WHERE NOT y) AS b FROM x GROUP BY p), h AS (SELECT *, coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
s AS (SELECT CAST(sum(a) AS BIGINT) AS pos, CAST(sum(b) AS BIGINT) AS neg, sum(a * (below + b / 2)) AS area, coalesce(sum(a) FILTER (WHERE p >= 0.5), 0)::DOUBLE AS tp, coalesce(sum(b) FILTER (WHERE p >= 0.5), 0)::DOUBLE AS fp FROM h)
SELECT pos, neg, round(area::DOUBLE / (pos::DOUBLE * neg), 9) AS auc, round(tp / (tp + fp), 9) AS precision, round(tp / pos, 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos), 9) AS f1 FROM s"""

#: A model over all 64 numbers of a vector; every ninth does not vary enough to be scaled.
MODEL = {"weights": [(i * 7 % 11 - 5) / 10 for i in range(64)], "bias": -0.2, "mean": [(i % 5 - 2) / 20 for i in range(64)], "std": [1e-9 if i % 9 == 2 else 0.5 + i % 4 / 2 for i in range(64)]}


@query
def logreg_score(spark, d):
    e = read(spark, d, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", rounded(logit_score(x, **MODEL), 9).alias("score"))


_TERMS = " + ".join(f"(embedding[{i + 1}]::DOUBLE - ({m!r})) / {s if s >= 1e-6 else 1.0!r} * ({w!r})" for i, (w, m, s) in enumerate(zip(MODEL["weights"], MODEL["mean"], MODEL["std"])))
SQL["logreg_score"] = f"SELECT vec_id, round(1 / (1 + exp(-({_TERMS} - 0.2))), 9) AS score FROM embeddings"


def _scored(spark, d):
    e = timeline(spark, d, CAND)
    return e.select("clip", "id", "t", (F.col("conf") / 500).alias("score"), (F.col("id") % 7 / 7.0).alias("attack_norm"), (F.col("id") % 5 / 5.0).alias("e_high_ratio"), (F.col("id") % 3 / 3.0).alias("e_low_ratio"), (F.col("id") % 4).alias("cluster"))


@query
def fingerprint_confidence(spark, d):
    return score.fingerprint_confidence(_scored(spark, d)).select("clip", "id", rounded("confidence", 6).alias("confidence"))


SQL["fingerprint_confidence"] = f"""WITH {EV}, x AS (SELECT clip, id, id % 4 AS cluster, conf / 500 + 0.08 * (id % 7 / 7.0) + 0.05 * (id % 5 / 5.0) + 0.05 * (id % 3 / 3.0) AS s FROM ev WHERE kind = '{CAND}'),
a AS (SELECT clip, quantile_cont(s, 0.5) AS med FROM x GROUP BY clip), b AS (SELECT x.clip, quantile_cont(abs(s - med), 0.5) AS mad FROM x JOIN a ON a.clip = x.clip GROUP BY x.clip), c AS (SELECT clip, cluster, quantile_cont(s, 0.5) AS inn FROM x GROUP BY 1, 2)
SELECT x.clip, x.id, round(0.5 / (1 + exp(-least(greatest((s - med) / ((mad + 1e-9) * 1.4826 + 1e-9), -5.0), 5.0))) + 0.5 / (1 + exp(-(s - inn) / 0.15)), 6) AS confidence FROM x JOIN a ON a.clip = x.clip JOIN b ON b.clip = x.clip JOIN c ON c.clip = x.clip AND c.cluster = x.cluster"""


@query
def score_fusion(spark, d):
    e = timeline(spark, d, DET)
    other = F.when(F.col("id") % 4 > 0, (F.col("id") % 10) / 10.0)
    return e.select("clip", "id", rounded(score.fuse(F.col("conf") / 500, other), 6).alias("conf"))


SQL["score_fusion"] = f"WITH {EV} SELECT clip, id, round(CASE WHEN id % 4 > 0 THEN 0.5 * conf / 500 + 0.5 * (id % 10) / 10.0 ELSE conf / 500 END, 6) AS conf FROM ev WHERE kind = '{DET}'"


@query
def weighted_score(spark, d):
    x = _scored(spark, d).withColumn("slam", F.col("id") % 11 == 0)
    s = score.weighted_score({"score": 0.6, "attack_norm": 0.3, "e_high_ratio": 0.1}, {"slam": 0.25})
    return x.select("clip", "id", rounded(s, 6).alias("score"))


SQL["weighted_score"] = f"WITH {EV} SELECT clip, id, round(0.6 * conf / 500 + 0.3 * (id % 7) / 7.0 + 0.1 * (id % 5) / 5.0 - CASE WHEN id % 11 = 0 THEN 0.25 ELSE 0 END, 6) AS score FROM ev WHERE kind = '{CAND}'"


@query
def logreg_train(spark, d):
    """Rows only: gradient descent; tests compare it with NumPy."""
    e = read(spark, d, "embeddings").select(F.col("embedding").alias("x"), (F.col("label") < 5).cast("int").alias("y"))
    m = score.logreg_train(e, "x", "y")
    rows = [(i, float(w), float(a), float(s)) for i, (w, a, s) in enumerate(zip(m["weights"], m["mean"], m["std"]))] + [(-1, m["bias"], 0.0, 1.0)]
    return spark.createDataFrame(rows, "i int, weight double, mean double, std double")


@query
def training_set(spark, d):
    c = timeline(spark, d, CAND).withColumn("features", F.array("conf"))
    out = score.training_set(c, timeline(spark, d, REF), HOUR, TOL)
    return out.select("clip", "id", "t", F.col("features")[0].alias("x"), "label", "weight")


SQL["training_set"] = f"""WITH {EV}, {role('r', REF)}, {role('c', CAND)}, miss AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.clip = r.clip AND c.t - r.t BETWEEN {-HOUR} AND {TOL})),
near AS (SELECT * FROM (SELECT miss.clip, c.id, c.t, c.conf, row_number() OVER (PARTITION BY miss.clip, miss.id ORDER BY abs(c.t - miss.t), c.t, c.id) AS k FROM miss JOIN c ON c.clip = miss.clip) WHERE k = 1)
SELECT clip, id, t, conf AS x, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.clip = c.clip AND c.t - r.t BETWEEN {-HOUR} AND {TOL}) THEN 1 ELSE 0 END AS label, 1.0::DOUBLE AS weight FROM c UNION ALL SELECT clip, id, t, conf, 1, 4.5::DOUBLE FROM near"""


def _clips(spark, d):
    # a clip starts at its first event
    return timeline(spark, d).groupBy("clip").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))


@query
def negative_windows(spark, d):
    c = _clips(spark, d)
    shots = timeline(spark, d, DET).join(c, "clip").select("clip", "id", (F.col("t") - F.col("t0")).alias("t"))
    return score.negative_windows(c.select("clip", (F.col("t1") - F.col("t0")).alias("duration")), shots, 4 * HOUR, 8 * HOUR)


_CL = f"{EV}, cl AS (SELECT clip, min(t) AS t0, max(t) - min(t) AS dur FROM ev GROUP BY clip), sh AS (SELECT ev.clip, ev.t - t0 AS t FROM ev JOIN cl ON cl.clip = ev.clip WHERE kind = '{DET}')"
SQL["negative_windows"] = f"""WITH {_CL}, g AS (SELECT clip, unnest(range(0, dur - {4 * HOUR}, {2 * HOUR})) AS start FROM cl WHERE dur > {4 * HOUR}), f AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY start) - 1 AS k, count(*) OVER (PARTITION BY clip) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.clip = g.clip AND abs(start + {2 * HOUR} - sh.t) < {8 * HOUR})),
w AS (SELECT clip, count(*) AS want FROM sh GROUP BY clip) SELECT f.clip, start, start + {4 * HOUR} AS "end" FROM f JOIN w ON w.clip = f.clip WHERE k % greatest(1, n // want) = 0 AND k / greatest(1, n // want) < want"""


@query
def random_negatives(spark, d):
    c = _clips(spark, d)
    b = timeline(spark, d, BEEP).join(c, "clip").select("clip", "id", (F.col("t") - F.col("t0")).alias("t"))
    return score.random_negatives(c.select("clip", (F.col("t1") - F.col("t0")).alias("duration")), b, 20, 6 * HOUR, HOUR)


SQL["random_negatives"] = f"""WITH {_CL}, be AS (SELECT ev.clip, ev.t - t0 AS t FROM ev JOIN cl ON cl.clip = ev.clip WHERE kind = '{BEEP}'), dr AS (SELECT clip, dur, unnest(range(20)) AS id FROM cl WHERE dur > {HOUR}),
x AS (SELECT clip, id, CAST(floor(('0x' || left(md5(clip || '|' || id || '|42'), 13))::BIGINT / 4503599627370496.0::DOUBLE * (dur - {HOUR})) AS BIGINT) AS t FROM dr) SELECT clip, id, t FROM x WHERE NOT EXISTS (SELECT 1 FROM be WHERE be.clip = x.clip AND abs(be.t - x.t) <= {6 * HOUR})"""


@query
def shell_features(spark, d):
    """Twelve values around every detection, four of them before it."""
    from tidemark.operators.signal import as_series

    s = as_series(timeline(spark, d))
    marks = s.join(timeline(spark, d, DET).select("clip", "id"), ["clip", "id"], "left_semi").select("clip", "id", (F.col("idx") - 4).alias("at"))
    near = marks.withColumn("idx", F.explode(F.sequence(F.col("at"), F.col("at") + 11)))
    near = near.join(s.select("clip", "idx", "value"), ["clip", "idx"]).select("clip", "id", (F.col("idx") - F.col("at")).alias("idx"), (F.col("value") / 1999).alias("value"))
    out = score.shell_features(near, 4)
    return out.select("clip", "id", *[rounded(F.col("features")[i], 6).alias(f"f{i}") for i in range(8)])


SQL["shell_features"] = f"""WITH {EV}, x AS (SELECT clip, id, kind, row_number() OVER (PARTITION BY clip ORDER BY t, id) - 1 AS p, conf / 1999 AS v FROM ev), y AS (SELECT m.clip, m.id, x.p - m.p + 4 AS i, x.v FROM x m JOIN x ON x.clip = m.clip AND x.p BETWEEN m.p - 4 AND m.p + 7 WHERE m.kind = '{DET}'),
g AS (SELECT clip, id, coalesce(max(v) FILTER (WHERE i < 4), 0) AS b, coalesce(max(v) FILTER (WHERE i >= 4), 0) AS a, coalesce(avg(v) FILTER (WHERE i >= 4), 0) AS m, list(i ORDER BY v DESC, i)[1] AS pk, count(*) AS n, list(v) FILTER (WHERE i >= 4) AS xs FROM y GROUP BY clip, id)
SELECT clip, id, round(least(1.0, a / 0.08), 6) AS f0, round(least(1.0, b / 0.08), 6) AS f1, round(least(1.0, (a - b) / 0.08), 6) AS f2, round(least(1.0, m / 0.08), 6) AS f3, CASE WHEN pk >= 4 THEN 1.0 ELSE 0.0 END AS f4, round(len(list_filter(coalesce(xs, []), lambda q: q > greatest(b * 1.5, 1e-5)))::DOUBLE / greatest(len(coalesce(xs, [])), 1), 6) AS f5, round(pk::DOUBLE / greatest(n - 1, 1), 6) AS f6, round(least(1.0, greatest(0.0, a / (b + 1e-6) - 1) / 5), 6) AS f7 FROM g"""


@query
def hard_negatives(spark, d):
    x = timeline(spark, d, CAND).select("clip", "id", (F.col("conf") / 500).alias("e_low_ratio"), (F.col("id") % 10 / 10.0).alias("flatness"), (F.col("id") % 9 / 4.0).alias("r2_log"), (F.col("id") % 8 / 8.0).alias("attack_norm"))
    slam = (F.col("e_low_ratio") > 0.65) | ((F.col("e_low_ratio") > 0.55) & (F.col("flatness") < 0.22))
    metal = (F.col("r2_log") > 1.2) & (F.col("flatness") > 0.5) & (F.col("attack_norm") < 0.4)
    return x.select("clip", "id", slam.alias("slam"), metal.alias("metal"))


SQL["hard_negatives"] = f"WITH {EV} SELECT clip, id, conf / 500 > 0.65 OR (conf / 500 > 0.55 AND id % 10 / 10.0 < 0.22) AS slam, id % 9 / 4.0 > 1.2 AND id % 10 / 10.0 > 0.5 AND id % 8 / 8.0 < 0.4 AS metal FROM ev WHERE kind = '{CAND}'"


@query
def calibration_score(spark, d):
    """Settings are clips here: matches, detections and references of each."""
    m = matching.match_order_preserving(timeline(spark, d, REF), timeline(spark, d, DET), TOL)
    n = timeline(spark, d, DET).groupBy("clip").agg(F.count("*").alias("n_det"))
    per = m.groupBy("clip").agg(F.count("*").alias("n_gt"), F.count("det_id").alias("n"), F.avg("dt").alias("mae")).join(n, "clip").withColumnRenamed("clip", "setting")
    return search.calibration_score(per).select("setting", "n", rounded("score", 6).alias("score"), "best")


from tidemark.plans.q_match import _BEHIND, _near, _walk_refs  # noqa: E402

SQL["calibration_score"] = f"""WITH RECURSIVE {RD}, {_walk_refs('r', 'd', _near(str(TOL)), _BEHIND)}, g AS (SELECT clip, count(*) AS n_gt, count(hit) AS n, avg(abs(hit.t - rt)) AS mae FROM w WHERE w.n > 0 GROUP BY clip), nd AS (SELECT clip, count(*) AS n_det FROM d GROUP BY clip),
x AS (SELECT g.clip AS setting, g.n, mae, g.n - 0.10 * greatest(0, n_det - n_gt) + 0.05 * greatest(0, n_gt - n_det) AS score FROM g JOIN nd ON nd.clip = g.clip) SELECT setting, n, round(score::DOUBLE, 6) AS score, row_number() OVER (ORDER BY score DESC, mae ASC NULLS LAST, setting) = 1 AS best FROM x"""


@query
def verified_overrides(spark, d):
    o = timeline(spark, d, BEEP).groupBy("clip").agg(F.min("t").alias("t"))
    near = matching.asof_nearest(o.withColumn("id", F.lit(0).cast("long")), timeline(spark, d, CAND).select("clip", "id", "t"), 2 * HOUR)
    return search.verified_overrides(o, near.where("near is not null").select("clip", F.col("near.t").alias("t")))


SQL["verified_overrides"] = f"WITH {EV}, {role('c', CAND)}, o AS (SELECT clip, min(t) AS t FROM ev WHERE kind = '{BEEP}' GROUP BY clip), n AS (SELECT * FROM (SELECT o.clip, c.t, row_number() OVER (PARTITION BY o.clip ORDER BY abs(c.t - o.t), c.t, c.id) AS k FROM o JOIN c ON c.clip = o.clip AND abs(c.t - o.t) <= {2 * HOUR}) WHERE k = 1) SELECT o.clip, coalesce(n.t, o.t) AS t, n.t IS NOT NULL AS verified FROM o LEFT JOIN n ON n.clip = o.clip"
