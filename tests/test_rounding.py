"""Values on a rounding edge, and windows whose mean is 0, come out as in the SQL."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.plans import q_match
from tidemark.plans.bind import rounded


def test_edges_are_rounded_as_in_the_sql(spark, tmp_path):
    edges = [(int(k) * 2 + 1) * 5 / 10**6 for k in np.random.default_rng(0).integers(0, 10**7, 2000)]
    spark.createDataFrame([(x * s,) for x in edges for s in (1, -1)] + [(float("inf"),), (float("nan"),), (None,)], "x double").write.parquet(f"{tmp_path}/x")
    x = spark.read.parquet(f"{tmp_path}/x").select("x", rounded("x", 5).alias("y"))
    x.write.parquet(f"{tmp_path}/y")
    apart = duckdb.connect().execute(f"select count(*) from '{tmp_path}/y/*.parquet' where y is distinct from round(x, 5)").fetchone()[0]
    assert apart == 0 and x.where(F.col("y") != F.round("x", 5)).count() > 0


def test_window_stats_of_nothing_and_on_an_edge(spark, tmp_path):
    events = [(1, 0, 1, "purchase", 0.0), (2, 0, 2, "purchase", 63.4), (3, 60, 2, "view", 64.6), (5, 0, 3, "purchase", -1.5), (6, 0, 4, "purchase", -1.0), (7, 9, 4, "view", 1.0), (8, 0, 5, "purchase", None)]
    rows = spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string, value double")
    rows.select("event_id", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select event_id, ts::timestamp as ts, user_id, event_type, value from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    got = q_match.window_stats(spark, str(tmp_path)).orderBy("ref_id").collect()
    want = con.execute(f"select {', '.join(f'"{c}"' for c in got[0].asDict())} from ({q_match.SQL['window_stats']}) order by ref_id").fetchall()
    assert list(map(repr, map(tuple, got))) == list(map(repr, want))
