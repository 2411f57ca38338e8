"""Signals in blocks: all events in order of their ids are one clip, the values its samples, in blocks of SIZE at RATE a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import blocks, dedup, kernels, metrics
from tidemark.params import Candidates, Stft
from tidemark.plans.bind import EV, HOUR, read, rounded, timeline

QUERIES, SQL = {}, {}
RATE, SIZE = 1000.0, 1000
SMALL = Stft(n_fft=16, hop=4, low_hz=80, high_hz=400, bands=((50, 150), (150, 300), (300, 450)))


def query(f):
    QUERIES[f.__name__] = f
    return f


def _cut(spark, d):
    return blocks.as_blocks(read(spark, d, "events").select(F.lit(0).alias("clip"), F.col("event_id").alias("idx"), "value"), RATE, SIZE)


@query
def clip_stft(spark, d):
    f = blocks.stft_frames(blocks.halo(_cut(spark, d), SIZE, *blocks.stft_reach(SMALL)), SMALL)
    return f.select("idx", F.posexplode("mag").alias("bin", "mag")).select("idx", "bin", rounded("mag", 5).alias("mag"))


_X = "x AS (SELECT event_id AS i, value AS v FROM events), n AS (SELECT max(i) + 1 AS n FROM x)"
_STFT = f"""{_X}, w AS (SELECT x.i // 4 - j AS idx, x.i - 4 * (x.i // 4 - j) AS k, v FROM x, (SELECT unnest(range(4)) AS j) WHERE x.i // 4 - j >= 0),
st AS (SELECT idx, bin, sqrt(pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 15)) * cos(2 * pi() * k * bin / 16)), 2) + pow(sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 15)) * sin(2 * pi() * k * bin / 16)), 2)) AS mag
FROM w, (SELECT unnest(range(9)) AS bin) WHERE idx * 4 + 16 <= (SELECT n FROM n) GROUP BY idx, bin)"""
SQL["clip_stft"] = f"WITH {_STFT} SELECT idx, CAST(bin AS INT) AS bin, round(mag, 5) AS mag FROM st"


@query
def clip_features(spark, d):
    c = Candidates()
    f = blocks.frame_features(blocks.halo(_cut(spark, d), SIZE, *blocks.feature_reach(RATE, SMALL, c)), SMALL, c)
    return f.select("idx", *[rounded(n, 4).alias(n) for n in ("onset", "e_low", "e_mid", "e_high", "flatness", "attack")])


SQL["clip_features"] = f"""WITH {_STFT}, d AS (SELECT idx, bin, greatest(ln(1 + mag) - lag(ln(1 + mag)) OVER (PARTITION BY bin ORDER BY idx), 0) AS up FROM st WHERE bin * 62.5 BETWEEN 80 AND 400),
f AS (SELECT idx, coalesce(sum(up), 0) AS flux FROM d GROUP BY idx), o AS (SELECT idx, sum(flux) OVER (ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 AS onset FROM f),
e AS (SELECT idx, sum(CASE WHEN bin * 62.5 >= 50 AND bin * 62.5 < 150 THEN mag * mag ELSE 0 END) AS e_low, sum(CASE WHEN bin * 62.5 >= 150 AND bin * 62.5 < 300 THEN mag * mag ELSE 0 END) AS e_mid, sum(CASE WHEN bin * 62.5 >= 300 AND bin * 62.5 < 450 THEN mag * mag ELSE 0 END) AS e_high,
exp(avg(ln(mag)) FILTER (WHERE mag > 1e-9)) / (avg(mag) + 1e-9) AS flatness FROM st GROUP BY idx),
a AS (SELECT i, sum(abs(v)) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS env FROM x), s AS (SELECT i, env - lag(env) OVER (ORDER BY i) AS up FROM a),
t AS (SELECT i, CASE WHEN i >= 10 THEN max(up) OVER (ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 0.01 ELSE 0 END AS slope FROM s), m AS (SELECT i // 4 AS idx, max(slope) AS attack FROM t GROUP BY 1)
SELECT e.idx, round(onset, 4) AS onset, round(e_low, 4) AS e_low, round(e_mid, 4) AS e_mid, round(e_high, 4) AS e_high, round(flatness, 4) AS flatness, round(attack, 4) AS attack FROM e JOIN o ON o.idx = e.idx JOIN m ON m.idx = e.idx"""


@query
def clip_bandpass(spark, d):
    out = blocks.bandpass(_cut(spark, d), SIZE, 50.0, 200.0)
    return out.select((F.col("start")).alias("start"), F.posexplode("samples").alias("k", "y")).select((F.col("start") + F.col("k")).alias("idx"), rounded("y", 6).alias("y"))


def _recursion() -> str:
    """One sample a step: each section's output is the next one's input, and it leaves its two states."""
    sections = kernels.butter_band(4, 50.0 / (RATE / 2), 200.0 / (RATE / 2)).tolist()
    steps, columns = ["x.v AS y0"], []
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        # alternately named, so that the states of the step before are read
        steps += [f"{b0!r} * y{k} + r.p{k} AS y{k + 1}", f"{b1!r} * y{k} - {a1!r} * y{k + 1} + r.q{k} AS np{k}", f"{b2!r} * y{k} - {a2!r} * y{k + 1} AS nq{k}"]
        columns += [f"p{k}", f"q{k}"]
    body = "SELECT x.i AS i, " + ", ".join(steps) + " FROM r JOIN x ON x.i = r.i + 1"
    last = f"y{len(sections)}"
    return f"r(i, y, {', '.join(columns)}) AS (SELECT -1::BIGINT, 0::DOUBLE, {', '.join(['0::DOUBLE'] * len(columns))} UNION ALL SELECT i, {last}, {', '.join('n' + c for c in columns)} FROM ({body}))"


SQL["clip_bandpass"] = f"WITH RECURSIVE {_X}, {_recursion()} SELECT i AS idx, round(y, 6) AS y FROM r WHERE i >= 0"


@query
def clip_prominence(spark, d):
    cut = _cut(spark, d)
    return blocks.prominences(cut, blocks.local_maxima(cut, SIZE), SIZE).select("idx", rounded("prominence", 6).alias("prominence"))


_PEAKS = f"""{_X}, g AS (SELECT *, sum(b) OVER (ORDER BY i) AS run FROM (SELECT *, CASE WHEN v <> lag(v) OVER (ORDER BY i) THEN 1 ELSE 0 END AS b FROM x)),
u AS (SELECT run, min(i) AS lo, max(i) AS hi, min(v) AS v FROM g GROUP BY run), k AS (SELECT *, lag(v) OVER (ORDER BY run) AS before, lead(v) OVER (ORDER BY run) AS after FROM u),
p AS (SELECT (lo + hi) // 2 AS i, v FROM k WHERE before < v AND after < v)"""
SQL["clip_prominence"] = f"""WITH {_PEAKS}, l AS (SELECT p.i, p.v, coalesce(max(x.i) FILTER (WHERE x.i < p.i), -1) AS a, coalesce(min(x.i) FILTER (WHERE x.i > p.i), (SELECT n FROM n)) AS b FROM p LEFT JOIN x ON x.v > p.v GROUP BY p.i, p.v)
SELECT l.i AS idx, round(l.v - greatest(min(x.v) FILTER (WHERE x.i <= l.i), min(x.v) FILTER (WHERE x.i >= l.i)), 6) AS prominence FROM l JOIN x ON x.i > l.a AND x.i < l.b GROUP BY l.i, l.v"""


@query
def clip_maxima(spark, d):
    """Of the values in steps of 40, so that there are plateaus."""
    cut = _cut(spark, d).withColumn("samples", F.transform("samples", lambda v: F.floor(v / 40).cast("double")))
    return blocks.local_maxima(cut, SIZE).select("idx", "value")


SQL["clip_maxima"] = f"WITH {_PEAKS.replace('value AS v', 'floor(value / 40) AS v')} SELECT i AS idx, v AS value FROM p"


@query
def clip_suppress(spark, d):
    """All events in one clip, which has no gap."""
    return dedup.suppress_priority(timeline(spark, d).withColumn("clip", F.lit(0)), HOUR, stretches=True).select("id", "t", "conf")


SQL["clip_suppress"] = f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (ORDER BY conf DESC, t DESC, id DESC) AS n FROM ev), w(n, id, t, conf, kept, here) AS (
SELECT n, id, t, conf, [t], true FROM o WHERE n = 1 UNION ALL
SELECT o.n, o.id, o.t, o.conf, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.t) < {HOUR})) = 0 THEN list_append(w.kept, o.t) ELSE w.kept END, len(list_filter(w.kept, lambda x: abs(x - o.t) < {HOUR})) = 0
FROM w JOIN o ON o.n = w.n + 1) SELECT id, t, conf FROM w WHERE here"""


@query
def clip_percentiles(spark, d):
    """Linear percentiles of one clip of all events, and of each user's, without a buffer of values."""
    e = timeline(spark, d)
    out = None
    for q in (0.3, 0.5, 0.92, 0.995):
        for name, rows in (("all", e.withColumn("clip", F.lit(-1).cast("long"))), ("user", e)):
            found = metrics.percentile_by_ranges(rows, "conf", q).select(F.lit(name).alias("of"), "clip", F.lit(q).alias("q"), "n", rounded("percentile", 6).alias("percentile"))
            out = found if out is None else out.unionByName(found)
    return out


SQL["clip_percentiles"] = f"WITH {EV}, q AS (SELECT unnest([0.3, 0.5, 0.92, 0.995])::DOUBLE AS q), " + "r AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS of, {clip} AS clip, {q}::DOUBLE AS q, count(*) AS n, round(quantile_cont(conf, {q}), 6) AS percentile FROM ev GROUP BY 2" for q in (0.3, 0.5, 0.92, 0.995) for name, clip in (("all", "(-1)::BIGINT"), ("user", "clip"))
) + ") SELECT * FROM r"
