import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup
from tidemark.plans.bind import HOUR
from tidemark.streaming import events


def stream(spark, tmp_path, rows):
    src = tmp_path / "in"
    rows.write.parquet(str(src))
    return spark.readStream.schema(rows.schema).parquet(str(src))


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.ROCKS_DB)


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def made(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 5")
    rows = e.select(F.col("user_id").cast("string").alias("clip"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("conf"))
    return rows.coalesce(1)


def test_folds_equal_the_batch_rules_but_for_open_rows(spark, tmp_path):
    rows = made(spark)
    batch = rows.withColumn("t", F.unix_micros("ts"))
    s = stream(spark, tmp_path, rows)
    for name in ("nms_anchored", "dedup_last_kept", "thin_keep_first"):
        got = {(r.clip, r.id) for r in drained(getattr(events, name)(s, 6 * HOUR, "1 hour"), name).collect()}
        want = {(r.clip, r.id) for r in getattr(dedup, name)(batch, 6 * HOUR).collect()}
        assert got <= want and len(want - got) <= 5, name


def test_gap_chains_close_behind_the_watermark(spark, tmp_path):
    rows = made(spark)
    got = drained(events.gap_chains(stream(spark, tmp_path, rows), "6 hours", "1 hour"), "chains").count()
    want = dedup.cluster_session_window(rows.withColumn("t", F.unix_micros("ts")), 6 * HOUR).count()
    assert 0 < got <= want


@pytest.mark.parametrize("name", ["nms_anchored", "dedup_last_kept", "thin_keep_first"])
def test_rows_out_of_order_give_the_batch_result(spark, tmp_path, name):
    """Batches of rows shuffled within the watermark's delay, ties of time among them: all but what is still open equals the batch rule."""
    rng = random.Random(name)
    minute = 60_000_000
    rows = sorted((rng.randrange(2000) * minute, c, i, float(rng.randrange(9))) for c in "ab" for i in range(150))
    rows = [(c, i + 1000 * (c == "b"), t, v) for t, c, i, v in rows]
    moved = sorted(rows, key=lambda r: r[2] + rng.randrange(100) * minute)
    src = tmp_path / "in"
    src.mkdir()
    end = [(c, 9000 + k, 10_000 * minute * k, 0.0) for k in (1, 2, 3) for c in "ab"]  # lets the watermark pass all rows before
    files = [moved[k : k + 40] for k in range(0, len(moved), 40)] + [end[k : k + 2] for k in (0, 2, 4)]
    for k, part in enumerate(files):
        pd.DataFrame(part, columns=["clip", "id", "t", "conf"]).assign(ts=lambda x: pd.to_datetime(x["t"], unit="us")).drop(columns="t").to_json(src / f"{k:03}.json", orient="records", lines=True, date_format="iso", date_unit="us")
        os.utime(src / f"{k:03}.json", (k + 1, k + 1))
    schema = "clip string, id long, ts timestamp, conf double"
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    got = {(r.clip, r.id, r.t) for r in drained(getattr(events, name)(live, 20 * minute, "100 minutes"), "ordered_" + name).collect()}
    batch = spark.createDataFrame(rows, "clip string, id long, t long, conf double")
    assert {g for g in got if g[1] < 9000} == {(r.clip, r.id, r.t) for r in getattr(dedup, name)(batch, 20 * minute).collect()}
