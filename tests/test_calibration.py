"""The calibration search's matches for all settings at once, against a match for each setting alone."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.operators.matching import match_order_preserving


@pytest.mark.parametrize("look", [1, 3, 256])
def test_settings_together_match_as_each_alone(spark, monkeypatch, look):
    monkeypatch.setattr(search, "LOOK", look)
    rng = random.Random(look)
    refs, found = [], []
    for c in range(8):
        span = rng.choice([10, 60, 400])
        refs += [(f"c{c}", i, rng.randrange(span)) for i in range(rng.choice([0, 1, 30]))]
        for s in range(5):
            found += [(f"c{c}", s, i, rng.randrange(span)) for i in range(rng.choice([0, 1, 2, 40]))]
    r = spark.createDataFrame(refs, "clip string, id long, t long")
    f = spark.createDataFrame(found, "clip string, setting int, id long, t long")
    keys = ("clip", "setting")
    settings = r.withColumn("setting", F.explode(F.array(*[F.lit(s) for s in range(5)])))
    alone = match_order_preserving(settings, f, 4, keys).groupBy("clip", "setting").agg(F.count("det_id").alias("n"), F.coalesce(F.sum("dt"), F.lit(0)).alias("dt"))
    want = {(x.clip, x.setting): (x.n, x.dt) for x in alone.collect() if x.n}
    rows = search._in_turn_by_setting(r, f, 4).collect()
    assert want and {(x.clip, x.setting): (x.n, x.dt) for x in rows if x.n} == want
    counts = {}
    for c, s, _, _ in found:
        counts[c, s] = counts.get((c, s), 0) + 1
    assert {(x.clip, x.setting): x.n_det for x in rows} == counts
