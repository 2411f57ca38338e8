import random

from tidemark.llm import linededup


def words(x):
    return len([w for w in x.replace("\t", " ").split(" ") if w.strip("\x0b\x0c\r")])


def brute(rows, m, longest=None):
    """rows: (doc_id, text), unique. Marks lines of every repeated run with m words or more, by trying all runs (of `longest` lines at most: a longer one is the union of such)."""
    rows = sorted(rows, key=lambda r: r[0])
    seqs = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if words(x)] for d, t in rows}
    first = {}
    for d, _ in rows:
        s = seqs[d]
        for a in range(len(s)):
            for b in range(a, len(s) if longest is None else min(len(s), a + longest)):
                key = tuple(x for _, x in s[a : b + 1])
                first.setdefault(key, (d, a))
                first[key] = min(first[key], (d, a))
    out = {}
    for d, t in rows:
        s, gone = seqs[d], set()
        for a in range(len(s)):
            for b in range(a, len(s) if longest is None else min(len(s), a + longest)):
                key = tuple(x for _, x in s[a : b + 1])
                if sum(words(x) for x in key) >= m and first[key] < (d, a):
                    gone |= {i for i, _ in s[a : b + 1]}
        for (i, _), (j, _) in zip(s, s[1:]):  # wordless lines between two that go
            if i in gone and j in gone:
                gone |= set(range(i, j))
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


def test_against_all_runs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pool = ["a", "b b", "c c c", "d d d d d", "", " ", "long line of eight words is here ok", "e e"]
        rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for k in range(40)] + [(90, None), (91, "")]
        for m in (1, 5, 8):
            got = linededup.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string"), m)
            assert {r.doc_id: r.kept_text for r in got.collect()} == brute(rows, m)


def test_odd_rows(spark, odd, none):
    got = linededup.delete_repeats(odd)
    assert got.count() == odd.count()
    assert {r.kept_text for r in got.collect() if r.doc_id == 4} == {"one"}
    assert linededup.delete_repeats(none).count() == 0
    line = "one line with a good many words in it"
    df = spark.createDataFrame([(None, line, "x", "s", 1), (3, line + "\nown", "x", "s", 1), (3, line + "\nown", "x", "s", 1), (4, line, None, None, None)], odd.schema.fieldNames()[:5] and "doc_id long, text string, lang string, source string, n_chars long")
    out = linededup.drop_repeats(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect()) == [("3", "own", 3), ("3", "own", 3), ("None", line, 1)]


def test_repeated_rows_are_one_document(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pool = ["a a a", "b b b", "c c", "d", "", "e e e e"]
        rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(3, 9)))) for k in range(20)]
        rows += [(100, "a a a\nb b b\nc c c\nf"), (101, "a a a\nb b b\nc c c\ng")]
        copies = rows + rng.choices(rows, k=15) + [rows[-1]] * 2 + [rows[-2]] * (seed > 0)
        rng.shuffle(copies)
        got = linededup.delete_repeats(spark.createDataFrame(copies, "doc_id long, text string")).collect()
        want = brute(rows, 8)
        assert sorted((r.doc_id, r.kept_text) for r in got) == sorted((d, want[d]) for d, _ in copies)
        assert want[101] == "g"
    line = "a a a\nb b b\nc c c"
    lost = linededup.delete_repeats(spark.createDataFrame([(None, line), (None, line), (2, line), (2, line)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in lost) == [("2", "")] * 2 + [("None", line)] * 2


def test_no_python_in_the_plan(docs):
    import io
    from contextlib import redirect_stdout

    with redirect_stdout(out := io.StringIO()):
        linededup.delete_repeats(docs).explain()
    assert "Python" not in out.getvalue() and "Pandas" not in out.getvalue()


def test_names_in_use(spark):
    from tidemark.llm import linededup

    names = ["runs", "uid", "doc", "_id", "removed_runs", "kept_text", "i", "x", "l"]
    text = "a b c d e f g h\nx y"
    docs = spark.createDataFrame([(k, text, *[f"{n}{k}" for n in names]) for k in range(2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = {r.doc_id: r for r in linededup.drop_repeats(docs).collect()}
    assert out[0].text == text and out.get(1) is None
    kept = linededup.delete_repeats(docs).collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in kept for n in names if n not in ("removed_runs", "kept_text"))
