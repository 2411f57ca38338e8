import numpy as np

from tidemark.llm import language


def brute_forward_backward(e, t):
    n, k = e.shape
    a, prev = [], np.full(k, 1.0 / k)
    for i in range(n):
        prev = (prev @ t) * e[i]
        prev = prev / prev.sum()
        a.append(prev)
    b, out, pair = np.ones(k), np.zeros((n, k)), np.zeros((k, k))
    for i in range(n - 1, -1, -1):
        p = a[i] * b
        out[i] = p / p.sum()
        before = a[i - 1] if i else np.full(k, 1.0 / k)
        j = before[:, None] * t * (e[i] * b)[None]
        pair += j / j.sum()
        b = t @ (e[i] * b)
        b = b / b.sum()
    return out, pair


def test_blocks_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 63, 64, 65, 0, 200, 1000, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.random((first[-1], 4)) + 1e-3
    t = rng.random((4, 4)) + 0.05
    got, pair = language.forward_backward(e, first, t)
    want_pair = np.zeros((4, 4))
    for a, b in zip(first, first[1:]):
        if b > a:
            want, p = brute_forward_backward(e[a:b], t)
            assert np.allclose(got[a:b], want)
            want_pair += p
    assert np.allclose(pair, want_pair)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs, ~out, per_language=60)
    rows = language.predict(docs, model).where(out).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    # code-switched words
    pick = {r.lang: r.text.split()[:40] for r in docs.where("n_chars > 600").collect()}
    mixed = spark.createDataFrame([(1, " ".join(pick["en"] + pick["de"] + pick["fr"]))], "doc_id long, text string")
    runs = language.word_labels(mixed, model).first().runs
    word = [x for r in runs for x in [r.lang] * (r.end - r.start)]
    assert len(word) == 120
    assert np.mean([a == b for a, b in zip(word, ["en"] * 40 + ["de"] * 40 + ["fr"] * 40)]) > 0.85


def test_query_against_plain_loops(spark, docs):
    """Labels and scores of whole texts from features word by word and the plain recursion."""
    model = language.fit(docs, per_language=20)
    w, t = model["weights"], model["t"]
    texts = [r.text for r in docs.limit(60).collect()] + ["one", "123 ?!", "", None, "Ünïcode WÖRD und the le 77 !!"]
    rows = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        found = []
        for word in (texts[r.doc_id] or "").encode().split():
            data = language._lowered(np.frombuffer(word, np.uint8))
            _, bucket = language._features(data, np.array([0]), np.array([len(data)]))
            lettered = any(language.LETTER[x] for x in word)
            z = w[bucket].astype(float).sum(0) if lettered else np.zeros(w.shape[1])
            found.append((np.exp(np.maximum(z - z.max(), -30)), lettered))
        if not any(x for _, x in found):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        marginal, _ = brute_forward_backward(np.array([e for e, _ in found]), t)
        mass = marginal[[x for _, x in found]].mean(0)
        assert r.lang_pred == model["names"][mass.argmax()] and np.isclose(r.score, mass.max())


def test_names_in_use(spark, docs):
    model = language.fit(docs, per_language=5)
    odd = spark.createDataFrame([(1, "the word", "own", 5)], "doc_id long, text string, lang_pred string, score int")
    r = language.predict(odd, model, "_label", "_score").first()
    assert (r.lang_pred, r.score) == ("own", 5) and r._label in model["names"]


def test_sample_is_bounded(spark):
    rows = [(i, "word " * (10 if i else 5000), "en") for i in range(50)]
    seen = []
    train = language.train
    language.train = lambda texts, labels: seen.extend(texts) or train(texts, labels)
    try:
        language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10, sample_bytes=300)
    finally:
        language.train = train
    assert seen and (len(seen) == 1 or sum(map(len, seen)) <= 300)


def test_odd_rows(spark, odd, none, docs):
    model = language.fit(docs, per_language=10)
    got = language.predict(odd, model)
    assert got.columns == [*odd.columns, "lang_pred", "score"] and got.count() == odd.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    assert by[4].lang_pred in model["names"]
    assert language.predict(none, model).count() == 0
    empty = language.fit(none)
    assert {r.lang_pred for r in language.predict(odd, empty).collect()} == {"und"}
    marks = spark.createDataFrame([(1, "123 !!!   —")], "doc_id long, text string")
    assert language.predict(marks, model).first().lang_pred == "und"
