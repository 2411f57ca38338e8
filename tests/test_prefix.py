"""Running totals over all keys, and no task that sees them all."""

import random

import pytest

from tidemark.operators import audit, prefix


@pytest.mark.parametrize("kind", ["long", "string"])
def test_totals_before(spark, kind):
    rng = random.Random(2)
    keys = rng.sample(range(-5000, 5000), 700)
    rows = [(k if kind == "long" else f"k{k}", rng.randrange(9)) for k in keys] + [(None, 3)]
    got = prefix.totals_before(spark.createDataFrame(rows, f"k {kind}, n long").repartition(7), "k", "n", "base").collect()
    want, total = {}, 0
    for k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0].encode() if kind == "string" and r[0] else r[0])):
        want[k], total = total, total + n
    assert {r["k"]: r["base"] for r in got} == want and len(got) == len(rows)
    assert prefix.totals_before(spark.createDataFrame([], f"k {kind}, n long"), "k", "n", "base").collect() == []


def test_manifest_orders_no_single_partition(spark):
    fp = spark.createDataFrame([("a", 1, 5, 0.5, 9), ("b", 1, 4, 0.2, 3)], "clip string, id long, t long, conf double, distance long")
    fn = spark.createDataFrame([("a", 2, 7, 1)], "clip string, id long, t long, det_dt long")
    out = audit.manifest(fp, fn)
    assert sorted(r["audit_id"] for r in out.collect()) == ["a|FN|0001", "a|FP|0001", "b|FP|0002"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("[clip" in x for x in windows)
