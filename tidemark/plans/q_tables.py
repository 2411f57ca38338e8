"""Queries over sidecar texts and records: documents and event properties stand for the files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.plans import q_match
from tidemark.plans.bind import BEEP, DET, EV, HOUR, read, role, timeline
from tidemark.sources import parse, readers, sinks

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def parse_decimals(spark, d):
    x = read(spark, d, "documents").select("doc_id", parse.decimals(F.col("text")).alias("xs"))
    return x.where(F.size("xs") > 0).select("doc_id", F.posexplode("xs").alias("idx", "x"))


SQL["parse_decimals"] = r"WITH x AS (SELECT doc_id, regexp_extract_all(text, '(\d+\.\d+)', 1) AS xs FROM documents) SELECT doc_id, CAST(unnest(range(len(xs))) AS INT) AS idx, CAST(unnest(xs) AS DOUBLE) AS x FROM x WHERE len(xs) > 0"


def _lines(spark, d):
    """Event properties of a user as the lines of its sidecar: the value behind "k", or the whole text for some."""
    e = read(spark, d, "events")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    k = F.get_json_object("props", "$.k")
    line = F.when(F.col("event_id") % 7 == 0, F.col("props")).when(F.col("event_id") % 11 == 0, F.lit("# note")).when(F.col("event_id") % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), k, F.lit(".5")))
    return e.select(F.col("user_id").alias("clip"), n.alias("line_no"), line.alias("line"))


_L = "ln AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no, CASE WHEN event_id % 7 = 0 THEN props WHEN event_id % 11 = 0 THEN '# note' WHEN event_id % 13 = 0 THEN '  ' ELSE ' ' || json_extract_string(props, '$.k') || '.5' END AS line FROM events), num AS (SELECT *, TRY_CAST(trim(line) AS DOUBLE) AS t FROM ln)"


@query
def parse_times_lenient(spark, d):
    return parse.times_lenient(_lines(spark, d))


SQL["parse_times_lenient"] = f"WITH {_L} SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY t, line_no) - 1 AS INT) AS idx, t FROM num WHERE t IS NOT NULL"


@query
def parse_times_strict(spark, d):
    """The same lines with a number where a document stands, which a strict reader refuses."""
    return parse.times_strict(_lines(spark, d).withColumn("line", F.when(F.startswith("line", F.lit("{")), F.concat(F.lit("  "), F.length("line"), F.lit(".25"))).otherwise(F.col("line"))))


SQL["parse_times_strict"] = f"WITH {_L} SELECT clip, CAST(line_no AS INT) AS line_no, CASE WHEN starts_with(line, '{{') THEN length(line) + 0.25::DOUBLE ELSE t END AS t FROM num WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')"


@query
def beep_last_line(spark, d):
    return parse.beep_last(_lines(spark, d))


SQL["beep_last_line"] = f"WITH {_L} SELECT clip, arg_max(t, line_no) AS t FROM num WHERE t IS NOT NULL GROUP BY clip"


@query
def beep_first_line(spark, d):
    return parse.beep_first(_lines(spark, d))


SQL["beep_first_line"] = f"WITH {_L} SELECT clip, t FROM num WHERE line_no = 0"


@query
def count_lines(spark, d):
    return parse.count_lines(_lines(spark, d))


SQL["count_lines"] = f"WITH {_L} SELECT clip, count(*) FILTER (WHERE trim(line) <> '') AS n FROM ln GROUP BY clip"


@query
def detector_backend(spark, d):
    e = read(spark, d, "events")
    side = F.when(F.col("event_id") % 3 == 0, F.lit(" CNN ")).when(F.col("event_id") % 3 == 1, F.lit("other"))
    note = F.when(F.col("event_id") % 2 == 0, F.lit("# shot_detector = ast"))
    return e.select("event_id", parse.backend(side, note, "auto").alias("backend"))


SQL["detector_backend"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'cnn' WHEN event_id % 2 = 0 THEN 'ast' ELSE 'auto' END AS backend FROM events"


def _gaps(spark, d):
    """Gaps between a user's detections, in hours: splits; its first beep in hours since the first event: the start."""
    from pyspark.sql import Window

    base = timeline(spark, d).groupBy("clip").agg(F.min("t").alias("b"))
    w = Window.partitionBy("clip").orderBy("t", "id")
    x = timeline(spark, d, DET).join(base, "clip")
    rel = ((F.col("t") - F.col("b")) / float(HOUR))
    x = x.withColumn("x", rel).withColumn("idx", F.row_number().over(w) - 1)
    splits = x.withColumn("split", F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(0.0)))
    start = timeline(spark, d, BEEP).join(base, "clip").groupBy("clip").agg(F.min((F.col("t") - F.col("b")) / float(HOUR)).alias("t0"))
    return splits.select("clip", "idx", "x", "split"), start


_G = f"{EV}, {role('d', DET)}, b0 AS (SELECT clip, min(t) AS b FROM ev GROUP BY clip), x AS (SELECT d.clip, row_number() OVER (PARTITION BY d.clip ORDER BY t, id) - 1 AS idx, (t - b) / {float(HOUR)} AS x FROM d JOIN b0 ON b0.clip = d.clip), sp AS (SELECT *, x - coalesce(lag(x) OVER (PARTITION BY clip ORDER BY idx), 0.0) AS split FROM x), st AS (SELECT ev.clip, min((t - b) / {float(HOUR)}) AS t0 FROM ev JOIN b0 ON b0.clip = ev.clip WHERE kind = '{BEEP}' GROUP BY ev.clip)"


@query
def splits_to_times(spark, d):
    s, start = _gaps(spark, d)
    return parse.splits_to_times(s, start).select("clip", "idx", F.round("t", 6).alias("t"))


SQL["splits_to_times"] = f"WITH {_G} SELECT sp.clip, CAST(idx AS INT) AS idx, round(coalesce(t0, 0) + sum(split) OVER (PARTITION BY sp.clip ORDER BY idx), 6) AS t FROM sp LEFT JOIN st ON st.clip = sp.clip"


@query
def looks_absolute(spark, d):
    s, _ = _gaps(spark, d)
    mixed = s.withColumn("x", F.when(F.col("clip") % 2 == 0, F.col("x")).otherwise(F.col("split")))
    return parse.looks_absolute(mixed)


_MIX = f"{_G}, mx AS (SELECT clip, idx, CASE WHEN clip % 2 = 0 THEN x ELSE split END AS x FROM sp), ga AS (SELECT *, x - lag(x) OVER (PARTITION BY clip ORDER BY idx) AS gap FROM mx), ab AS (SELECT clip, count(*) >= 2 AND min(x) >= 0.2 AND coalesce(min(gap), 0) >= -0.01 AS absolute FROM ga GROUP BY clip)"
SQL["looks_absolute"] = f"WITH {_MIX} SELECT * FROM ab"


@query
def reference_times(spark, d):
    s, start = _gaps(spark, d)
    mixed = s.withColumn("x", F.when(F.col("clip") % 2 == 0, F.col("x")).otherwise(F.col("split")))
    cali = s.where("clip % 5 = 0")
    return parse.reference_times(cali, mixed, start).select("clip", F.col("idx").cast("long").alias("idx"), F.round("t", 6).alias("t"), "source")


SQL["reference_times"] = f"""WITH {_MIX}, z AS (SELECT mx.*, absolute, coalesce(t0, 0.0) AS t0, first_value(mx.x) OVER (PARTITION BY mx.clip ORDER BY mx.idx) AS f, sum(mx.x) OVER (PARTITION BY mx.clip ORDER BY mx.idx) AS run FROM mx JOIN ab ON ab.clip = mx.clip LEFT JOIN st ON st.clip = mx.clip WHERE mx.clip % 5 <> 0)
SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY x, idx) - 1 AS idx, round(x, 6) AS t, 'cali' AS source FROM sp WHERE clip % 5 = 0 UNION ALL SELECT clip, idx, round(CASE WHEN absolute THEN CASE WHEN f < t0 THEN t0 + x ELSE x END ELSE t0 + run END, 6), CASE WHEN absolute THEN 'absolute' ELSE 'splits' END FROM z"""


@query
def resolve_t0(spark, d):
    e = timeline(spark, d)
    first = lambda m, k: e.where((F.col("clip") % 4 == k) & (F.col("id") % m == 0)).groupBy("clip").agg(F.min("conf").alias("t"))
    return parse.resolve_t0(e.select("clip").distinct(), first(2, 0), first(3, 1).unionByName(first(3, 0)), first(5, 2))


SQL["resolve_t0"] = f"WITH {EV}, x AS (SELECT clip, min(conf) FILTER (WHERE clip % 4 = 0 AND id % 2 = 0) AS a, min(conf) FILTER (WHERE clip % 4 IN (0, 1) AND id % 3 = 0) AS b, min(conf) FILTER (WHERE clip % 4 = 2 AND id % 5 = 0) AS c FROM ev GROUP BY clip) SELECT clip, coalesce(a, b, c, 0.0) AS t0, CASE WHEN a IS NOT NULL THEN 'file' WHEN b IS NOT NULL THEN 'override' WHEN c IS NOT NULL THEN 'detector' ELSE 'none' END AS source FROM x"


def _files(spark, d):
    """Pages as a file listing: folder and name from the address."""
    p = read(spark, d, "pages")
    return p.select(F.concat(F.lit("f"), F.col("page_id") % 20, F.when(F.col("page_id") % 20 == 7, F.lit("/backup")).otherwise(F.lit(""))).alias("folder"), F.format_string("%04d.mp4", F.col("page_id") * 37 % 1000).alias("name")).distinct()


_FILES = "fl AS (SELECT DISTINCT 'f' || (page_id % 20) || CASE WHEN page_id % 20 = 7 THEN '/backup' ELSE '' END AS folder, format('{:04d}.mp4', page_id * 37 % 1000) AS name FROM pages)"


@query
def split_legacy_last(spark, d):
    return readers.split_legacy(_files(spark, d))


SQL["split_legacy_last"] = f"WITH {_FILES} SELECT folder || '/' || name AS rel_path, CASE WHEN row_number() OVER (PARTITION BY folder ORDER BY name DESC) = 1 THEN 'val' ELSE 'train' END AS split FROM fl"


@query
def split_regenerate(spark, d):
    return readers.split_regenerate(_files(spark, d))


SQL["split_regenerate"] = f"WITH {_FILES} SELECT folder || '/' || name AS rel_path, CASE WHEN row_number() OVER (PARTITION BY folder ORDER BY name) = 1 THEN 'val' ELSE 'train' END AS split FROM fl WHERE NOT contains(lower(folder), 'backup')"


@query
def split_by_folder(spark, d):
    x = readers.split_by_folder(readers.split_legacy(_files(spark, d)))
    return x.select("folder", F.array_join("names", ",").alias("names"))


SQL["split_by_folder"] = f"WITH {_FILES}, s AS (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY name DESC) AS k FROM fl) SELECT folder, string_agg(name, ',' ORDER BY name) AS names FROM s WHERE k > 1 GROUP BY folder"


@query
def probe_metadata(spark, d):
    e = read(spark, d, "events")
    rate = F.when(F.col("event_id") % 5 == 0, F.lit("30000/1001")).when(F.col("event_id") % 5 == 1, F.lit("25/1")).when(F.col("event_id") % 5 == 2, F.lit("0/0")).when(F.col("event_id") % 5 == 3, F.lit("")).otherwise(F.lit("60"))
    meta = e.select(F.col("event_id").alias("clip"), rate.alias("r_frame_rate"), F.col("value").cast("string").alias("duration"), F.when(F.col("event_id") % 2 == 0, F.lit("N/A")).otherwise(F.lit("0.25")).alias("start_time"))
    return readers.probe(meta).select("clip", F.round("fps", 6).alias("fps"), "duration_s", "start_s")


SQL["probe_metadata"] = "SELECT event_id AS clip, round(CASE event_id % 5 WHEN 0 THEN 30000 / 1001.0 WHEN 1 THEN 25.0 WHEN 4 THEN 60.0 ELSE 30.0 END::DOUBLE, 6) AS fps, value AS duration_s, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 0.25 END::DOUBLE AS start_s FROM events"


@query
def audit_markers(spark, d):
    e = read(spark, d, "events")
    v = F.col("value").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"fp":[3,'), v, F.lit('],"fn":[1]}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"times":['), v, F.lit(",2]}"))).otherwise(F.concat(F.lit('{"false_negatives":['), v, F.lit("]}")))
    m = e.select("event_id", parse.audit_markers(text).alias("m"))
    return m.select("event_id", F.size("m.fp").alias("n_fp"), F.get("m.fp", F.lit(0)).alias("fp0"), F.size("m.fn").alias("n_fn"), F.get("m.fn", F.lit(0)).alias("fn0"))


SQL["audit_markers"] = "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 2 END AS n_fp, CASE event_id % 3 WHEN 0 THEN least(3.0, value) WHEN 1 THEN least(2.0, value) END AS fp0, CASE event_id % 3 WHEN 1 THEN 0 ELSE 1 END AS n_fn, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 2 THEN value END AS fn0 FROM events"


@query
def relative_times(spark, d):
    return sinks.relative_times(timeline(spark, d, DET), timeline(spark, d, BEEP), 6)


SQL["relative_times"] = f"""WITH {EV}, {role('d', DET)}, b AS (SELECT clip, min(t) AS t0 FROM ev WHERE kind = '{BEEP}' GROUP BY clip),
h AS (SELECT * FROM (VALUES (0, '# shot times since the beep'), (1, '# seconds'), (2, '# one per line')) AS v(line_no, line))
SELECT clip, CAST(line_no AS INT) AS line_no, line FROM h, (SELECT DISTINCT clip FROM d) UNION ALL
SELECT d.clip, CAST(row_number() OVER (PARTITION BY d.clip ORDER BY t, id) + 2 AS INT), printf('%.6f', (t - coalesce(t0, 0)) / 1000000.0) FROM d LEFT JOIN b ON b.clip = d.clip"""


@query
def to_splits(spark, d):
    s, _ = _gaps(spark, d)
    return sinks.to_splits(s.withColumnRenamed("x", "t"), 5)


SQL["to_splits"] = f"WITH {_G} SELECT clip, CAST(idx AS INT) AS idx, round(split, 5) AS split FROM sp"


@query
def to_absolute(spark, d):
    s, start = _gaps(spark, d)
    return sinks.to_absolute(s.withColumnRenamed("x", "t"), start, 5)


SQL["to_absolute"] = f"WITH {_G} SELECT x.clip, CAST(idx AS INT) AS idx, round(t0 + x, 5) AS t FROM x JOIN st ON st.clip = x.clip"


@query
def to_relative(spark, d):
    s, start = _gaps(spark, d)
    return sinks.to_relative(s.withColumnRenamed("x", "t"), start, 0.5, 5)


SQL["to_relative"] = f"WITH {_G} SELECT x.clip, CAST(idx AS INT) AS idx, round(CASE WHEN min(x) OVER (PARTITION BY x.clip) >= t0 - 0.5 THEN x - t0 ELSE x END, 5) AS t FROM x JOIN st ON st.clip = x.clip"


@query
def latest_record(spark, d):
    h = timeline(spark, d).select("clip", "t", "id", "conf")
    return sinks.latest(h, "clip", "t")


SQL["latest_record"] = f"WITH {EV} SELECT clip, max(t) AS t, arg_max(id, t) AS id, arg_max(conf, t) AS conf FROM ev GROUP BY clip"


@query
def label_override(spark, d):
    from tidemark.operators.matching import label_override as merge

    e = read(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("audit_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.lit("")).alias("human_primary"))
    o = e.where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("audit_id"), F.lit("echo").alias("human_primary"))
    return merge(rows, o).select("audit_id", "primary")


SQL["label_override"] = "SELECT CAST(event_id AS VARCHAR) AS audit_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'echo' END AS \"primary\" FROM events"


@query
def events_document(spark, d):
    """What the JSON of every clip says, read back: the text itself differs between engines."""
    clips = timeline(spark, d).select("clip").distinct().withColumn("fps", F.lit(30.0))
    x = sinks.events_document(clips, timeline(spark, d, DET), timeline(spark, d, BEEP))
    doc = F.from_json("document", "video struct<clip:long,fps:double>, t0_beep_s double, beeps array<struct<t:long,id:long>>, shots array<struct<t:long,id:long,conf:double>>, shot_times_since_beep array<double>")
    x = x.select("clip", doc.alias("j"))
    total = F.aggregate("j.shot_times_since_beep", F.lit(0.0), lambda s, v: s + v)
    return x.select("clip", F.col("j.video.fps").alias("fps"), F.col("j.t0_beep_s").alias("t0"), F.size(F.coalesce("j.beeps", F.array())).alias("beeps"), F.array_join(F.transform(F.coalesce("j.shots", F.array()), lambda r: r["id"]), ",").alias("shots"), F.round(F.coalesce(total, F.lit(0.0)), 3).alias("since"))


SQL["events_document"] = f"""WITH {EV}, c AS (SELECT DISTINCT clip FROM ev), b AS (SELECT clip, count(*) AS n, arg_min(t, (t, id)) AS t0 FROM ev WHERE kind = '{BEEP}' GROUP BY clip), s AS (SELECT clip, t, id FROM ev WHERE kind = '{DET}')
SELECT c.clip, 30.0::DOUBLE AS fps, coalesce(any_value(t0), 0) / 1e6 AS t0, CAST(coalesce(any_value(b.n), 0) AS INT) AS beeps, coalesce(string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY s.t, s.id), '') AS shots, round(coalesce(sum((s.t - coalesce(t0, 0)) / 1e6), 0)::DOUBLE, 3) AS since FROM c LEFT JOIN b ON b.clip = c.clip LEFT JOIN s ON s.clip = c.clip GROUP BY c.clip"""


_CONFIG = {"tolerance": 4, "nms": 1}


@query
def benchmark_record(spark, d):
    """The record without the time of the run."""
    return sinks.benchmark_record(q_match.prf_pooled(spark, d), "bench", "users", _CONFIG).select("meta.tag", "meta.split_sha256", "meta.config_sha256", "pooled.*")


SQL["benchmark_record"] = f"""SELECT 'bench' AS tag, left(sha256('users'), 16) AS split_sha256, left(sha256('{json.dumps(_CONFIG, sort_keys=True)}'), 16) AS config_sha256, p.* FROM ({q_match.SQL['prf_pooled']}) p"""
