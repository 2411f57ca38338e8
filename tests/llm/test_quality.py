import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = quality.posteriors(docs, train).join(test, "doc_id").collect()
    q = np.array([(r.p_quality >= 0.5) == (r.quality == 1) for r in got])
    t = np.array([(r.p_toxic >= 0.5) == (r.toxic == 1) for r in got])
    assert q.mean() > 0.97 and t.mean() > 0.95
    good = [r.p_quality >= 0.5 and r.p_toxic < 0.5 for r in got if r.quality == 1 and r.toxic == 0]
    assert np.mean(good) > 0.98


def brute_strength(groups, means):
    """Of a list of value lists: within over between variance."""
    n = sum(map(len, groups))
    within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups) / (n - len(groups)) if n > len(groups) else 0
    gap = sum(len(g) * (np.mean(g) - m) ** 2 for g, m in zip(groups, means))
    between = (gap - len(groups) * within) / n
    return min(max(within / between, 0.01), 1e6) if between > 1e-9 else 1e6


def test_query_against_loops(spark):
    """The whole operator, with sites of one document and of many, on a model that gives random evidence."""
    rng = np.random.default_rng(5)
    model = {"words": rng.normal(0, 1, (quality.BUCKETS, 2)).astype(np.float32), "dense": rng.normal(0, 0.3, (quality.DENSE, 2)).astype(np.float32)}
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), 6)), str(rng.choice(["x", "y", "z", None])), str(rng.choice(["p", "q"]))) for i in range(120)] + [(200, None, "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(rows[i][2] == "x"), int(i % 5 == 0)) for i in range(0, 120, 3)], "doc_id long, quality int, toxic int")
    truth = {r.doc_id: r for r in labels.collect()}
    got = {r.doc_id: r for r in quality.posteriors(docs, labels, model=model).collect()}
    assert len(got) == 121
    logit = lambda p: np.log(p / (1 - p))
    for t in ("quality", "toxic"):
        value = {i: float(truth[i][t]) if i in truth else got[i][f"e_{t}"] for i, *_ in rows}
        hosts, paths = {}, {}
        for i, _, h, p in rows:
            hosts.setdefault(h, []).append(i)
            paths.setdefault((h, p), []).append(i)
        of = lambda ids: [value[i] for i in ids]
        mean = np.mean(list(value.values()))
        kh = brute_strength([of(x) for x in hosts.values()], [mean] * len(hosts))
        host = {h: (sum(of(x)) + kh * mean) / (len(x) + kh) for h, x in hosts.items()}
        kp = brute_strength([of(x) for x in paths.values()], [host[h] for h, _ in paths])
        for i, _, h, p in rows:
            assert np.isclose(got[i][f"host_{t}"], host[h])
            assert np.isclose(got[i][f"path_{t}"], (sum(of(paths[h, p])) + kp * host[h]) / (len(paths[h, p]) + kp))
            without = lambda ids: [value[j] for j in ids if j != i]  # noqa: E731, B023
            base = np.mean(without(value))
            up = (sum(without(hosts[h])) + kh * base) / (len(hosts[h]) - 1 + kh)
            rate = (sum(without(paths[h, p])) + kp * up) / (len(paths[h, p]) - 1 + kp)
            z = logit(got[i][f"e_{t}"]) + logit(rate) - logit(base)
            assert np.isclose(got[i][f"p_{t}"], 1 / (1 + np.exp(-z)), atol=1e-6)


def test_sites_of_urls(spark):
    host, path = quality.url_sites(F.col("url"))
    rows = spark.createDataFrame([("https://A.example.com/fr/825?x=1",), ("http://b.example.net",), ("no url",), (None,)], "url string").select(host, path).collect()
    assert [tuple(r) for r in rows] == [("a.example.com", "fr"), ("b.example.net", None), (None, None), (None, None)]


def test_a_bad_host_lowers_its_documents(spark):
    model = {"words": np.zeros((quality.BUCKETS, 2), np.float32), "dense": np.zeros((quality.DENSE, 2), np.float32)}
    rows = [(i, "same words", "bad" if i < 300 else "good", "p") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 0 if i < 300 else 1, 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    by = {r.doc_id: r for r in quality.posteriors(docs, labels, model=model).collect()}
    assert by[1].p_quality < 0.5 < by[599].p_quality
    assert by[1].host_quality < by[1].e_quality


def test_odd_rows(spark, odd, none, docs):
    labels = spark.createDataFrame([(1, 1, None), (4, 0, 1), (4, 1, 1), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.posteriors(odd, labels)
    assert got.count() == odd.count()
    assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got.collect())
    assert quality.posteriors(none, labels).count() == 0
    assert quality.posteriors(odd, labels.limit(0)).count() == odd.count()
