"""De-duplication queries: all events of a user are one clip's detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dedup, metrics
from tidemark.plans.bind import DET, EV, HOUR, frames, read, role, rounded, timeline

W6, W1 = 6 * HOUR, HOUR
QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _all(spark, d):
    return timeline(spark, d)


@query
def nms_anchored(spark, d):
    return dedup.nms_anchored(_all(spark, d), W6)


_ORDERED = f"{EV}, o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t, id) AS n FROM ev)"


def _walk(state: str, first: str, then: str, out: str) -> str:
    """A recursive walk along each clip's rows, one row a step."""
    return f"""WITH RECURSIVE {_ORDERED}, w({state}) AS (
SELECT {first} FROM o WHERE n = 1 UNION ALL
SELECT {then} FROM w JOIN o ON o.clip = w.clip AND o.n = w.n + 1) {out}"""


SQL["nms_anchored"] = _walk(
    "clip, n, id, t, conf, anchor, grp", "clip, n, id, t, conf, t, 1",
    f"o.clip, o.n, o.id, o.t, o.conf, CASE WHEN o.t - w.anchor < {W6} THEN w.anchor ELSE o.t END, CASE WHEN o.t - w.anchor < {W6} THEN w.grp ELSE w.grp + 1 END",
    "SELECT clip, id, t, conf FROM (SELECT *, row_number() OVER (PARTITION BY clip, grp ORDER BY conf DESC, n) AS k FROM w) WHERE k = 1",
)


def _last_kept(gap: int, where: str = "") -> str:
    near = f"o.t - w.t < {gap}"
    take = f"({near} AND o.conf <= w.conf)"
    return _walk(
        "clip, n, id, t, conf, grp", "clip, n, id, t, conf, 1",
        f"o.clip, o.n, CASE WHEN {take} THEN w.id ELSE o.id END, CASE WHEN {take} THEN w.t ELSE o.t END, CASE WHEN {take} THEN w.conf ELSE o.conf END, CASE WHEN {near} THEN w.grp ELSE w.grp + 1 END",
        f"SELECT clip, id, t, conf FROM (SELECT *, row_number() OVER (PARTITION BY clip, grp ORDER BY n DESC) AS k FROM w) WHERE k = 1{where}",
    )


@query
def dedup_last_kept(spark, d):
    return dedup.dedup_last_kept(_all(spark, d), W6)


SQL["dedup_last_kept"] = _last_kept(W6)


@query
def dedup_moving_best(spark, d):
    return dedup.dedup_moving_best(_all(spark, d), 3 * HOUR, 70)


SQL["dedup_moving_best"] = f"""WITH kept AS ({_last_kept(3 * HOUR)}), n AS (SELECT user_id AS clip, count(*) AS c FROM events GROUP BY 1)
SELECT kept.clip, id, t, conf FROM kept JOIN n ON n.clip = kept.clip WHERE c > 70
UNION ALL SELECT user_id, event_id, epoch_us(ts), value FROM events JOIN n ON n.clip = user_id WHERE c <= 70"""


@query
def dedup_soft(spark, d):
    rows = _all(spark, d).withColumn("flatness", F.col("conf") / 500)
    return dedup.dedup_soft(rows, W1, W6, "flatness", 0.2)


SQL["dedup_soft"] = _walk(
    "clip, n, id, t, conf, grp", "clip, n, id, t, conf, 1",
    "o.clip, o.n, CASE WHEN {m} AND o.conf <= w.conf THEN w.id ELSE o.id END, CASE WHEN {m} AND o.conf <= w.conf THEN w.t ELSE o.t END, CASE WHEN {m} AND o.conf <= w.conf THEN w.conf ELSE o.conf END, CASE WHEN {m} THEN w.grp ELSE w.grp + 1 END".replace("{m}", f"(o.t - w.t BETWEEN {W1} AND {W6} AND abs(o.conf / 500 - w.conf / 500) < 0.2)"),
    "SELECT clip, id, t, conf, conf / 500 AS flatness FROM (SELECT *, row_number() OVER (PARTITION BY clip, grp ORDER BY n DESC) AS k FROM w) WHERE k = 1",
)


@query
def thin_keep_first(spark, d):
    return dedup.thin_keep_first(_all(spark, d), W6)


SQL["thin_keep_first"] = _walk(
    "clip, n, id, t, conf, last, kept", "clip, n, id, t, conf, t, true",
    f"o.clip, o.n, o.id, o.t, o.conf, CASE WHEN o.t - w.last >= {W6} THEN o.t ELSE w.last END, o.t - w.last >= {W6}",
    "SELECT clip, id, t, conf FROM w WHERE kept",
)

_CHAIN = f"{EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY clip ORDER BY t, id) > {W6} THEN 1 ELSE 0 END AS b FROM ev), c AS (SELECT clip, id, t, conf, CAST(sum(b) OVER (PARTITION BY clip ORDER BY t, id) AS BIGINT) AS cluster FROM g)"


@query
def cluster_gap_chain(spark, d):
    return dedup.cluster_gap_chain(_all(spark, d), W6).withColumn("cluster", F.col("cluster").cast("long"))


SQL["cluster_gap_chain"] = f"WITH {_CHAIN} SELECT clip, id, t, conf, cluster FROM c"


@query
def cluster_best(spark, d):
    return dedup.cluster_best(_all(spark, d), W6).select("clip", "id", "t", "conf")


SQL["cluster_best"] = f"WITH {_CHAIN} SELECT clip, id, t, conf FROM (SELECT *, row_number() OVER (PARTITION BY clip, cluster ORDER BY conf DESC, t, id) AS k FROM c) WHERE k = 1"


@query
def cluster_rank(spark, d):
    return dedup.cluster_rank(_all(spark, d), W6).select("clip", "id", F.col("rank").cast("long").alias("rank"))


SQL["cluster_rank"] = f"WITH {_CHAIN} SELECT clip, id, row_number() OVER (PARTITION BY clip, cluster ORDER BY conf DESC, t, id) AS rank FROM c"


@query
def cluster_session_window(spark, d):
    e = read(spark, d, "events")
    rows = e.select(F.col("user_id").alias("clip"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return dedup.cluster_session_window(rows, W6)


SQL["cluster_session_window"] = f"WITH {_CHAIN} SELECT clip, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM c GROUP BY clip, cluster"


@query
def suppress_priority(spark, d):
    return dedup.suppress_priority(_all(spark, d), W6)


SQL["suppress_priority"] = f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY conf DESC, t DESC, id DESC) AS n FROM ev), w(clip, n, id, t, conf, kept, here) AS (
SELECT clip, n, id, t, conf, [t], true FROM o WHERE n = 1 UNION ALL
SELECT o.clip, o.n, o.id, o.t, o.conf, CASE WHEN len(list_filter(w.kept, lambda x: abs(x - o.t) < {W6})) = 0 THEN list_append(w.kept, o.t) ELSE w.kept END, len(list_filter(w.kept, lambda x: abs(x - o.t) < {W6})) = 0
FROM w JOIN o ON o.clip = w.clip AND o.n = w.n + 1) SELECT clip, id, t, conf FROM w WHERE here"""


def _cap(cap: str, applies: str) -> str:
    return f"""WITH {EV}, x AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, CASE WHEN count(*) OVER (PARTITION BY clip) > 1 THEN (max(t) OVER (PARTITION BY clip) - min(t) OVER (PARTITION BY clip)) / 1000000.0 ELSE 1.0 END AS span, row_number() OVER (PARTITION BY clip ORDER BY conf DESC, t, id) AS place FROM ev)
SELECT clip, id, t, conf FROM x WHERE NOT ({applies}) OR place <= {cap}"""


#: Events come a few times a day; rates are a second's.
PER_DAY = 1 / 86400


@query
def rate_cap(spark, d):
    return dedup.rate_cap(_all(spark, d), PER_DAY, 2)


SQL["rate_cap"] = _cap(f"floor(span * {PER_DAY!r}) + 2", "n > 2")


@query
def rate_limit(spark, d):
    return dedup.rate_limit(_all(spark, d), 2.2 * PER_DAY, PER_DAY, 5)


SQL["rate_limit"] = _cap(f"floor(span * {PER_DAY!r}) + 5", f"n / span > {2.2 * PER_DAY!r}")


@query
def legacy_cap(spark, d):
    return dedup.legacy_cap(_all(spark, d), PER_DAY, 3)


SQL["legacy_cap"] = _cap(f"floor(span * {PER_DAY!r}) + 3", "n > 10")


@query
def post_filter(spark, d):
    return dedup.post_filter(_all(spark, d), 30.0, 0.4)


SQL["post_filter"] = f"WITH {EV}, m AS (SELECT clip, quantile_cont(conf, 0.5) AS med, count(*) AS n FROM ev GROUP BY clip) SELECT ev.clip, id, t, conf FROM ev JOIN m ON m.clip = ev.clip WHERE n <= 5 OR conf >= greatest(30.0, 0.4 * med)"


@query
def dominant_cluster(spark, d):
    rows = timeline(spark, d, DET).withColumn("label", (F.col("id") % 3).cast("int"))
    return dedup.dominant_cluster(rows).select("clip", "label", "n", rounded("mean", 6).alias("mean"))


SQL["dominant_cluster"] = f"WITH {EV}, {role('a', DET)}, g AS (SELECT clip, CAST(id % 3 AS INT) AS label, count(*) AS n, avg(conf) AS mean FROM a GROUP BY 1, 2) SELECT clip, label, n, round(mean, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY n DESC, mean DESC, label) AS k FROM g) WHERE k = 1"


@query
def kmeans_dominant(spark, d):
    """Rows only: cluster labels depend on the starting draws."""
    x = frames(spark, d).select("clip", F.col("vec_id").alias("id"), F.col("idx").alias("t"), F.lit(0.5).alias("conf"), F.col("mag").alias("features"))
    return dedup.kmeans_dominant(x).select("clip", "id", "pov_dominant")


@query
def kmeans_annotate(spark, d):
    """Rows only, as kmeans_dominant; nothing is dropped."""
    x = frames(spark, d).select("clip", F.col("vec_id").alias("id"), F.col("idx").alias("t"), F.lit(0.5).alias("conf"), F.col("mag").alias("features"))
    return dedup.kmeans_dominant(x, drop=False).select("clip", "id", "pov_dominant")


@query
def dynamic_window(spark, d):
    return metrics.dynamic_window(timeline(spark, d, DET), 0.4, HOUR, 12 * HOUR)


SQL["dynamic_window"] = f"WITH {EV}, {role('a', DET)}, g AS (SELECT clip, t - lag(t) OVER (PARTITION BY clip ORDER BY t, id) AS gap FROM a) SELECT clip, CASE WHEN count(*) < 3 THEN {HOUR}.0 ELSE least(greatest(quantile_cont(gap, 0.5) * 0.4, {HOUR}.0), {12 * HOUR}.0) END::DOUBLE AS window FROM g GROUP BY clip"
