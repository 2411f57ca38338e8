import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    out = []
    for key, text in docs:
        w = split(text)
        hit, found = set(), set()
        for item, t in items:
            iw = split(t)
            wins = [iw[i : i + 10] for i in range(max(1, len(iw) - 9))] if iw else []
            for x in wins:
                for i in range(len(w) - len(x) + 1):
                    if w[i : i + len(x)] == x:
                        hit |= set(range(i, i + len(x)))
                        found.add(str(item) if item is not None else "")
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def rows(df):
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return sorted(((r[0], r[1], r[2], list(r[3])) for r in df.select("doc_id", "n_words", n, "items").collect()), key=str)


def planted(spark, seed=5):
    rng = random.Random(seed)
    vocab = ["the", "of", "Ünd", "a1", "x", "QUX", "é"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(12)] + [(98, None), (99, ""), (3, "the of x")]
    docs = []
    for k in range(40):
        w = [rng.choice(vocab) for _ in range(60)]
        if k % 3 == 0:
            w[20:20] = (items[k % 12][1]).upper().split() if k % 2 else items[k % 12][1].split()
        docs.append((k, "-. ".join(w)))
    docs += [(40, None), (41, ""), (41, "")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    docs, items, d, b = planted(spark)
    assert rows(decontaminate.benchmark_matches(d, b)) == brute(docs, items)


def test_blocks_give_the_same(spark):
    docs, items, d, b = planted(spark, 6)
    assert rows(decontaminate.benchmark_matches(d, b, block_windows=7)) == brute(docs, items)


def test_driver_tables(spark, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = rows(decontaminate.benchmark_matches(docs.select("doc_id", "text"), bench))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert any(r[2] for r in got)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha beta filler gamma"), (2, "gamma x x x x alpha beta"), (3, "beta alpha gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    found = {r.doc_id: r["items"] for r in decontaminate.benchmark_matches(d, b, slop=1).collect()}
    assert found[1] == ["7"] and found[2] == [] and found[3] == []
    wider = {r.doc_id: r["items"] for r in decontaminate.benchmark_matches(d, b, slop=2).collect()}
    assert wider[1] == ["7"] and wider[2] == [] and wider[3] == ["7"]


def test_proximity_of_several_texts_against_brute_force():
    import numpy as np

    rng = random.Random(4)
    # term 0 is the rarest; it stands near the start of its texts, behind texts that end in the other terms
    texts = [[rng.choice([1, 2, 1, 2, -1]) for _ in range(rng.randrange(1, 6))] for _ in range(400)]
    for t in texts[::8]:
        t[min(len(t) - 1, rng.randrange(3))] = 0
    tid = np.array(sum(texts, []))
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    position = np.flatnonzero(tid >= 0)
    position = position[np.argsort(tid[position], kind="stable")]
    built = decontaminate.block_index(["x"], np.array([3]), np.array([1, 0, 2]), window=3)
    index = decontaminate.ranked(built, np.array([1, 2, 3]))
    for slop in (1, 2, 3):
        want = {d for d, t in enumerate(texts) for i, x in enumerate(t) if x == 0 and all(any(t[j] == term and abs(j - i - off) <= slop for j in range(len(t))) for term, off in ((1, -1), (2, 1)))}
        _, low, _ = decontaminate.match(index, tid[position], position, first, slop)
        assert want and set((np.searchsorted(first, low, "right") - 1).tolist()) == want


def test_index_serves_many_benchmarks(spark):
    docs, items, d, b = planted(spark, 9)
    index = decontaminate.build_index(d.repartition(3), segment_bytes=300)
    assert index.where("term is null").select("segment").distinct().count() > 5
    for part in (items[:5], items[5:]):
        found = decontaminate.search(index, spark.createDataFrame(part, "item_id long, text string"))
        assert rows(found) == brute(docs, part)


def test_rarity_is_that_of_the_corpus():
    import numpy as np

    built = decontaminate.block_index(["a", "b", "a"], np.array([3, 3, 2]), np.array([10, 20, 30, 10, 20, 30, 20, 40]), window=3)
    index = decontaminate.ranked(built, np.array([9, 2, 5, 0]))
    at = {tuple(r): k for k, r in enumerate(built["table"].tolist())}
    whole, gone = at[0, 1, 2], at[1, 3, -1]
    assert len(built["table"]) == 2 and index["ranks"][whole].tolist() == [1, 2, 0]
    assert index["alive"][whole] and not index["alive"][gone]
    assert [built["names"][i] for i in built["items"][built["first"][whole] : built["first"][whole + 1]]] == ["a", "b"]


def test_names_in_use(spark):
    names = ["spans", "items", "n_words", "name", "doc", "segment", "place"]
    docs = spark.createDataFrame([(k, "lost words here" if k else "other", *[f"{n}{k}" for n in names]) for k in range(2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = decontaminate.decontaminate(docs, spark.createDataFrame([(1, "lost words here")], "item_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0] and all(kept[0][n] == f"{n}0" for n in names)


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(None, "lost words here"), (1, None), (2, "text long")], "item_id long, text string")
    got = decontaminate.benchmark_matches(odd, b)
    assert got.count() == odd.count()
    assert {r.doc_id: r["items"] for r in got.collect() if r["items"]} == {None: [""], 5: ["2"]}
    assert decontaminate.decontaminate(odd, b).columns == odd.columns
    assert decontaminate.benchmark_matches(none, b).count() == 0
    assert decontaminate.benchmark_matches(odd, b.limit(0)).where("size(spans) > 0").count() == 0


def test_a_segment_is_hashed_in_parts(monkeypatch):
    """The hashes of a segment in parts are those of the whole, whatever the parts, and hashing takes the memory of a part."""
    import tracemalloc

    import numpy as np

    from tidemark.llm._text import ALNUM, forget_powers, word_hashes

    texts = [b"One two three", b"", b"  ", b"a" * 50, b"Four, five six." * 9, b"seven"] * 4
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    want = word_hashes(data, off, ALNUM, lower=True)
    for size in (1, 40, 100, 1 << 20):
        monkeypatch.setattr(decontaminate, "HASH_BYTES", size)
        got = decontaminate._hashes(data, off)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
    monkeypatch.undo()
    data = np.frombuffer(b"some words here " * (1 << 19), np.uint8)
    off = np.arange(0, len(data) + 1, 1 << 13)
    forget_powers()
    tracemalloc.start()
    decontaminate._hashes(data, off)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150 << 20
