import random

import pytest

from tidemark.llm import substring
from tidemark.llm.automaton import SuffixAutomaton


def brute(rows, window):
    first = {}
    seq = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in seq:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in seq:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "ß"]
    rows = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            if rows:
                src = rng.choice(rows)[1].split()
                a = rng.randrange(len(src) + 1)
                w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randrange(8, 50)]
        rows.append((rng.randrange(1000), " \n".join(w)))
    rows += [(2000 + k, rows[0][1]) for k in range(5)] + [(3000, None), (3001, ""), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize(("span", "fan"), [(4096, 512), (20, 2), (7, 0.001)])
def test_against_brute_force(spark, span, fan):
    """Shards of a few words, and parts of a few documents in every round, decide as whole ones."""
    for seed in range(2):
        rows = made(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        assert got(substring.remove_repeats(df, span=span, fan=fan)) == brute(rows, 13)


def test_one_text_in_most_documents(spark):
    """Copies and quotes of one text, near copies among them, in three rounds."""
    rng = random.Random(5)
    source = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(150):
        w = list(source) if k % 3 else source[k : k + 60]
        if k % 2:
            w[rng.randrange(len(w))] = f"x{k}"
        rows.append((rng.randrange(500), " ".join([f"a{k}", *w, f"b{k}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert got(substring.remove_repeats(df, span=50, fan=0.01)) == brute(rows, 13)


def test_names_in_use(spark):
    names = ["_id", "id", "key", "_key", "spans", "shared", "lead", "h"]
    docs = spark.createDataFrame([(k, "one two three " * 6 if k < 3 else None, *[f"{n}{k}" for n in names]) for k in range(4)], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names))
    out = substring.remove_repeats(docs).collect()
    assert len(out) == 4 and all(r[n] == f"{n}{r.doc_id}" for r in out for n in names)
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(0, 0), (1, 18), (2, 18), (3, 0)]
    with pytest.raises(TypeError):
        substring.remove_repeats(docs.withColumn("doc_id", docs["text"]))


def test_driver_table(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = got(substring.remove_repeats(docs.select("doc_id", "text")))
    assert out == brute(rows, 13)
    assert any(r[2] for r in out)


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 15))) for _ in range(4)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(t)
        q = "".join(rng.choice("abc") for _ in range(20))
        want = [max(n for n in range(i + 2) if not n or any(q[i + 1 - n : i + 1] in t for t in texts)) for i in range(len(q))]
        assert a.statistics(q) == want


def test_reference_is_broadcast_only_when_small(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b " + words + " c"), (2, None), (3, "w1 w2")], "doc_id long, text string")
    ref = spark.createDataFrame([("x " + words,), (None,)], "text string")
    assert got(substring.remove_reference_spans(docs, ref)) == [(1, 43, 40, "a b c"), (2, 0, 0, ""), (3, 2, 0, "w1 w2")]
    assert got(substring.remove_reference_spans(docs, ref, shard_words=10)) == got(substring.remove_reference_spans(docs, ref))
    with pytest.raises(ValueError):
        substring.remove_reference_spans(docs, ref, most_words=10)


def test_odd_rows(odd, none):
    out = substring.remove_repeats(odd)
    assert out.count() == odd.count() and "size" in out.columns
    assert {r.kept for r in out.collect() if r.doc_id == 4} == {"one"}
    assert substring.remove_repeats(none).count() == 0
