import re

import corpus_pipeline as P
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_linededup import words as count_words
from tests.llm.test_simhash import similar_roots

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def windows(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    tables = []
    for name, stage in P.STAGES:
        out = stage(spark, kept, SF)
        if name != "packing":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        rows = out.collect()
        tables.append(rows)
        kept = spark.createDataFrame(rows, out.schema)
    source = docs.collect()
    lang, line, near, bench, packed = tables
    # prose stays
    assert len(lang) > 0.95 * len(source)
    want = brute_lines([(r.doc_id, r.text) for r in lang], 8, 16)
    want = {d: t for d, t in want.items() if any(count_words(x) for x in t.split("\n")) or t == next(r.text for r in lang if r.doc_id == d)}
    assert {r.doc_id: r.text for r in line} == want
    assert all(r.n_chars == len(r.text) for r in line)
    assert {r.doc_id for r in near} == set(similar_roots([(r.doc_id, r.text) for r in line])[0].values())
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    bad = set().union(*(windows(r.text) for r in items))
    by_length = {len(x) for x in bad}

    def hit(text):
        w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        return any(tuple(w[i : i + n]) in bad for n in by_length for i in range(len(w) - n + 1))

    assert {r.doc_id for r in bench} == {r.doc_id for r in near if not hit(r.text)}
    assert {r.doc_id for r in packed} == {r.doc_id for r in bench}


def test_stages_keep_the_values_of_any_column(spark, docs):
    """Names that operators use inside belong to the caller."""
    from pyspark.sql import functions as F

    names = ["runs", "_id", "_n", "score", "lang_pred", "_letters", "spans", "items", "n_words", "place", "kept", "removed", "label", "uid", "name", "doc", "key"]
    kept = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, SF)
        rows = out.collect()
        assert len(rows) > 100 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
        kept = spark.createDataFrame(rows, out.schema)


def test_run_is_the_stages(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 100


def test_odd_rows(spark, odd, none):
    for docs in (odd.drop("items", "_bucket"), odd, none):
        kept = docs
        for name, stage in P.STAGES:
            out = stage(spark, kept, SF)
            if name != "packing":
                assert out.columns == docs.columns
            kept = spark.createDataFrame(out.collect(), out.schema)
