import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark, docs):
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in range(60):  # near copies, with a word or two changed
        i, text = rng.choice(rows[:150])
        w = text.split()
        w[rng.randrange(len(w))] = "zz"
        rows.append((1000 + k, " ".join(w)))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = {i: brute_fp(t) for i, t in rows}
    assert {r.doc_id: r.fp % (1 << 64) for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == brute_components(fps)


def test_linked_pairs_meet_in_one_list():
    rng = random.Random(2)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        keys = [tuple(f >> (8 * p) & 255 for p in s) for f in (x, y) for s in simhash.SETS]
        assert any(a == b for a, b in zip(keys[: len(simhash.SETS)], keys[len(simhash.SETS) :]))


def test_long_lists_against_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_BLOCK", 100)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 63))
    fps = set()
    for _ in range(600):  # they agree in five bytes
        x = base
        for bit in rng.choice(24, rng.integers(0, 7), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    links = simhash.link_list(fps)
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 3 for a, b in links)
    want = brute_components({i: int(f) for i, f in enumerate(fps)})
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert find(a) != find(b)
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(fps))] == [want[i] for i in range(len(fps))]
    assert len(links) > 100


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert sum(r.doc_id == 4 for r in got) == 2
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "None"]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_documents_against_jaccard(spark, docs):
    rng = random.Random(8)
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text.split()) > 120][:60]
    rows, near = list(base), {}
    for k, (i, text) in enumerate(base):
        w = text.split()
        for p in rng.sample(range(len(w)), max(1, len(w) // 80)):
            w[p] = "changed"
        rows.append((5000 + k, " ".join(w)))
        near[5000 + k] = len(shingles(text) & shingles(rows[-1][1])) / len(shingles(text) | shingles(rows[-1][1]))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [got[5000 + k] == got[i] for k, (i, _) in enumerate(base) if near[5000 + k] >= 0.85]
    assert len(caught) > 40 and np.mean(caught) > 0.97
    # documents that share little stay apart
    sets = {i: shingles(t) for i, t in base}
    for i, _ in base:
        if got[i] != i and got[i] in sets:
            assert len(sets[i] & sets[got[i]]) / len(sets[i] | sets[got[i]]) > 0.5


def near_copies(seed):
    """Texts in pairs around a similarity of 0.8, chains of them, short texts, and phrases that most texts hold."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    hot = [" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(3)]
    rows = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(rng.choice([6, 9, 25, 60, 150]))]
        w += hot[k % 3].split() * (k % 2)
        rows.append(" ".join(w))
        for _ in range(rng.randrange(1, 4)):
            for _ in range(max(1, round(len(w) * rng.choice([0.01, 0.02, 0.023])))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    return [(k, x) for k, x in enumerate(rows + ["a b", "A  b", "a b c d e", "a b c d e f", "a b c d e a b c d e f"])]


def similar_roots(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at, near = sorted(sets), 0
    for n, i in enumerate(at):
        for j in at[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                near += both * 20 < 17 * (len(sets[i]) + len(sets[j]) - both)
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, near


def test_similar_documents_are_exact(spark, monkeypatch):
    for seed, pairs in ((1, simhash.PAIRS), (2, 7)):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        rows = near_copies(seed)
        want, near = similar_roots(rows)
        assert near > 10
        got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_many_copies_make_few_pairs(spark):
    """A text in 200 variants and a second group beside it: pairs grow with the copies, not with their square."""
    rng = random.Random(6)
    rows = []
    for base in range(2):
        source = [f"b{base}x{k}" for k in range(120)]
        for k in range(200 if base else 30):
            w = list(source)
            for p in rng.sample(range(120), 1 + k % 3):
                w[p] = f"c{base}{k}{p}"
            rows.append((1000 * base + k, " ".join(w)))
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == similar_roots(rows)[0]


def test_chains_hang_together_in_any_batches():
    """Pairs and entries of lists do not depend on where batches end, and a list of equal sizes hangs together by few steps."""
    from fractions import Fraction

    import pyarrow as pa

    rng = np.random.default_rng(7)
    h = np.sort(np.concatenate([rng.integers(0, 300, 400), np.full(3000, 77)]))
    n = np.where(h == 77, 100, rng.integers(50, 120, len(h)))
    tid = rng.integers(-(1 << 62), 1 << 62, len(h))
    order = np.lexsort((tid, n, h))
    table = [x[order] for x in (h, n, tid, np.zeros(len(h), np.int64))]
    results = []
    for size in (len(h), 1, 2, 7, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[a : a + size]) for x in table], names=["h", "n", "tid", "place"]) for a in range(0, len(h), size)]
        rows = [r for batch in simhash._chained(Fraction(4, 5))(iter(batches)) for r in zip(*(c.to_pylist() for c in batch.columns))]
        results.append((sorted({r[:2] for r in rows if r[2] is None}), sorted(r for r in ((r[0], *r[2:]) for r in rows if r[2] is not None))))
    assert all(r == results[0] for r in results)
    pairs, entries = results[0]
    assert len(pairs) <= 2 * len(h)
    H, N = table[0], table[1]
    link = [False] + [H[i] == H[i - 1] and N[i - 1] * 5 >= N[i] * 4 for i in range(1, len(H))] + [False] * 2
    want = {int(table[2][i]) for i in range(len(H)) if (link[i] and link[i - 1]) or (link[i] and link[i + 1]) or (link[i + 1] and link[i + 2])}
    assert {e[0] for e in entries} == want
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    start = int(table[2][np.flatnonzero(H == 77)[1500]])
    seen, steps, edge = {start}, 0, [start]
    while edge:
        edge = list({y for x in edge for y in near[x]} - seen)
        seen |= set(edge)
        steps += bool(edge)
    assert len(seen & set(table[2][H == 77].tolist())) >= 3000 and steps < 40


def test_list_pairs_against_all_pairs():
    from fractions import Fraction

    rng = np.random.default_rng(4)
    share = Fraction(4, 5)
    for size in (1, 2, 3, 40):
        n = np.sort(rng.integers(10, 30, size))
        place, label = rng.integers(0, 4, size), rng.integers(0, 4, size)
        tid = rng.permutation(size) + 100
        got = set()
        for a, b in simhash.list_pairs(n, tid, place, label, share):
            got |= set(zip(a.tolist(), b.tolist()))
        want = {(min(tid[i], tid[j]), max(tid[i], tid[j])) for i in range(size) for j in range(i + 1, size) if label[i] != label[j] and n[i] * 5 >= n[j] * 4 and min(n[i] - place[i], n[j] - place[j]) * 9 >= (n[i] + n[j]) * 4}
        assert got == want


def test_similar_documents_of_the_table(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text and len(r.text) < 20000]
    got = simhash.similar_documents(docs.where("length(text) < 20000")).collect()
    assert {r.doc_id: r.component_id for r in got} == similar_roots(rows)[0]


def test_similar_documents_go_through_the_byte_index(spark, monkeypatch):
    """The stage's first candidates are the sets within three bits, by brute force over all fingerprints."""
    asked = []

    def links(distinct):
        asked.append({r.fp for r in distinct.collect()})
        return index(distinct)

    index = simhash.links
    monkeypatch.setattr(simhash, "links", links)
    source = [f"s{k}" for k in range(300)]
    rows = near_copies(5) + [(9000 + k, " ".join([*source[:k], f"new{k}", *source[k + 1 :]])) for k in range(0, 300, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert got == similar_roots(rows)[0] and len(asked) == 1
    sets = simhash._set_rows(docs, simhash.WIDTH, simhash.Fraction(4, 5)).dropDuplicates(["node"]).localCheckpoint()
    fps = {r.tid: r.fp % (1 << 64) for r in sets.collect()}
    assert {f - (1 << 64) if f >> 63 else f for f in fps.values()} == asked[0]
    want = brute_components(fps)
    root = {t: t for t in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash._near(sets).collect():
        x, y = find(r.a), find(r.b)
        root[max(x, y)] = min(x, y)
    assert {t: find(t) for t in fps} == want and len(set(want.values())) < len(fps) - 20


def test_similar_odd_rows(odd, none):
    got = simhash.similar_documents(odd).collect()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and len(got) == odd.count()
    assert simhash.similar_documents(none).count() == 0
    kept = simhash.drop_similar(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "None"]


def texts_of(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(999)) for _ in range(n))


A, B, C = (texts_of(k) for k in range(3))
NEAR_A = A + " more"
CASES = [
    ([(None, A), (None, B), (None, C)], [(None, A), (None, B), (None, C)]),
    ([(5, B), (5, C), (7, A)], [(5, B), (5, C), (7, A)]),
    ([(3, A), (5, A), (5, B)], [(3, A), (5, B)]),
    ([(None, A), (9, A), (None, B), (None, B)], [(9, A), (None, B)]),
    ([(5, A), (5, NEAR_A), (5, C), (None, NEAR_A)], None),
    ([(4, A), (4, B), (2, B), (2, C), (None, C), (None, None), (1, ""), (1, None), (8, " ")], None),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("drop", ["drop_similar", "drop_near_duplicates"])
def test_null_and_repeated_ids_lose_no_text(spark, case, drop):
    """Of every group of linked texts one row is left, whatever the ids are; by brute force over the rows themselves."""
    rows, want = CASES[case]
    got = [(r.doc_id, r.text) for r in getattr(simhash, drop)(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    if want is not None:
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    texts = [" ".join((t or "").split()) for _, t in rows]
    group = {NEAR_A: A}
    groups = {}
    for (i, t), key in zip(rows, texts):
        groups.setdefault(group.get(key, key), []).append((i is None, i or 0))
    assert len(got) == len(groups)
    for i, t in got:
        key = " ".join((t or "").split())
        assert (i is None, i or 0) == min(groups[group.get(key, key)])


def test_small_link_tables_settle_without_stars(spark, monkeypatch):
    """The edges of one task are contracted there: a chain needs no round of stars.  Spread over tasks they give the same components."""
    from tidemark.llm import components as module

    rng = random.Random(9)
    n = 300
    edges = [(i, i + 1) for i in range(n) if i % 37] + [(rng.randrange(n), rng.randrange(n)) for _ in range(20)]
    links = [(b - 150, a - 150) if rng.random() < 0.5 else (a - 150, b - 150) for a, b in edges]
    root = {x: x for e in links for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    # nodes that only loop on themselves have no edge
    want = {x: find(x) for e in links if e[0] != e[1] for x in e}
    df = spark.createDataFrame(links, "a long, b long")
    stars, large = [], module.large_star
    monkeypatch.setattr(module, "large_star", lambda edges: stars.append(1) or large(edges))
    assert {r.a: r.root for r in module.components(df).collect()} == want and not stars
    monkeypatch.setattr(module, "_directed", lambda edges, f=module._directed: f(edges).repartition(4))
    monkeypatch.setattr(module, "HELD", 3)
    assert {r.a: r.root for r in module.components(df).collect()} == want and stars
    assert module.components(df.where("a > 1000")).count() == 0


def test_few_pairs_are_verified_on_whole_sets(spark, monkeypatch):
    """Of a group of near copies, each set's best pairs are verified and not all of its candidates; nothing of the working tables stays."""
    import os

    from tidemark.shared import shared_folder

    asked, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda docs, pairs, *a: asked.append(pairs.count()) or verified(docs, pairs, *a))
    candidates, first = [], simhash._first
    monkeypatch.setattr(simhash, "_first", lambda likely: candidates.append(likely.count()) or first(likely))
    rng = random.Random(4)
    rows = []
    for k in range(150):
        w = [f"w{i}" for i in range(300)]
        for p in rng.sample(range(300), 2):
            w[p] = f"c{k}x{p}"
        rows.append((k, " ".join(w)))
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 150
    assert len(asked) == 2 and sum(asked) < candidates[0] and sum(asked) < 6 * 150
    folder = shared_folder(spark).removeprefix("file:")
    assert not [x for x in os.listdir(folder) if x.startswith("similar-")]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
