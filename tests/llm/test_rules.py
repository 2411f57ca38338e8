import random
import re
from collections import Counter

from tidemark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def got(df):
    return [(r.doc_id, (r.m.n_words, r.m.word_chars, r.m.n_symbols, r.m.n_dup_lines, r.m.n_repeat_words)) for r in rules.ledger(df).collect()]


def test_against_brute_force(spark, docs):
    rng = random.Random(2)
    extra = [(5000 + k, " ".join(rng.choice("abÉ ") for _ in range(rng.choice([7, 8, 9, 40, 80])))) for k in range(80)]
    extra += [(6000, "a\nb\na\n \n \n\x0b\na b#|<\n"), (6001, "x " * 3000), (6002, " wide\u0085 space")]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + extra
    assert sorted(got(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted((i, brute(t)) for i, t in rows)


def test_odd_rows(odd, none):
    assert sorted(map(str, got(odd))) == sorted(str((r.doc_id, brute(r.text))) for r in odd.collect())
    assert rules.ledger(none).count() == 0
    assert rules.ledger(odd.withColumnRenamed("lang", "m")).count() == odd.count()


def test_bits_policies_and_ablation(spark):
    clean = " ".join(f"word{i} and more" for i in range(30))
    rows = [(1, clean), (2, "short"), (3, clean.upper()), (4, clean + " " + " ".join(f"#x{i}" for i in range(40))), (5, "BAD")]
    kept = rules.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    bits = {r.doc_id: r.fail_bits for r in kept.collect()}
    b = rules.BITS
    assert bits[1] == 0 and bits[2] == b["few_words"] and bits[3] == b["capitals"] and bits[4] & b["symbols"] and bits[5] == b["few_words"] | b["capitals"]
    assert sorted(r.doc_id for r in kept.where(rules.passes("base-1")).collect()) == [1, 3, 4]
    table = {r.rule: r for r in rules.ablation(kept, "prose-1").collect()}
    assert table["capitals"].failed == 2 and table["capitals"].only_this == 1 and table["few_words"].kept_without == 2
    assert all(r.kept == 1 for r in table.values())


def test_no_python_in_the_plan(docs):
    import io
    from contextlib import redirect_stdout

    with redirect_stdout(out := io.StringIO()):
        rules.ledger(docs).explain()
    assert "Python" not in out.getvalue() and "Pandas" not in out.getvalue()
