"""Spelling variants against a comparison of all pairs of words, and the automata against sets."""

import random
import re
import zlib
from collections import Counter

import pytest
from tidemark.llm import queries, spelling


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def vocabulary(rows, length=6, times=5):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run if h % 199 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= length and n >= times}


def by_all_pairs(words):
    """word -> (form, root, n, n_near, form_n)."""
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    around = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, ()) if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(around[w]), words.get(form[w])) for w, n in words.items()}


def rows_of(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_over_the_table(spark, docs):
    words = vocabulary([tuple(r) for r in docs.select("doc_id", "text").collect()])
    want = by_all_pairs(words)
    assert len(want) > 500 and sum(v[0] is not None for v in want.values()) > 10
    got = queries.op11_spelling(spark, "/root/testdata/sf0.001")
    assert rows_of(got) == want and got.count() == len(want)


@pytest.mark.parametrize("group", [1, 8, 2048])
@pytest.mark.parametrize("letters,head", [("ab", ""), ("abÿé", ""), ("ab", "samehead" * 3)])
def test_partitions_of_any_size(spark, group, letters, head):
    """Repeated letters, words of many lengths, and a prefix that all words share, with partitions down to single places."""
    pick = random.Random(len(letters) + len(head))
    words = {head + "".join(pick.choices(letters, k=pick.randint(6, 11))): pick.choice([5, 9, 25, 60, 125, 625]) for _ in range(250)}
    want = {w: v for w, v in by_all_pairs(words).items() if v[3]}
    found = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), group).collect()
    assert len(found) == len(want)
    for r in found:
        best = min((x for x in words if near(r["word"], x)), key=lambda x: (-words[x], x))
        assert (r["n_near"], r["near"], r["near_n"]) == (want[r["word"]][3], best, words[best])


def test_full_partitions_are_halved(spark):
    words = [("same" * 4 + a + b + "tail" * 3, 5) for a in "abcdefghij" for b in "abcdefghij"]
    rows = spelling._places(spark.createDataFrame(words, "word string, n long"), 12)
    most = rows.groupBy("key", "lo", "hi").count()
    assert most.where("count > 12 and hi - lo > 1").count() == 0 and most.count() > 10


def test_chains_of_forms(spark):
    """Forms are followed to the last one."""
    words = ["abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    texts = [(k, " ".join([w] * 5 ** (k + 1))) for k, w in enumerate(words)]
    rows = [(d, t) for d, t in texts if zlib.crc32(f"{d}:{words[d]}".encode()) % 199]
    assert len(rows) == len(words)
    got = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {w: v[1] for w, v in got.items()} == dict.fromkeys(words, words[-1])
    assert got["abcdef"] == ("abcdefg", words[-1], 5, 1, 25) and got[words[-1]][0] is None


def test_acceptor_is_minimal():
    for words in (["ab", "abc", "b", "bc", "xab", "xabc"], ["", "a"], [], ["tap", "taps", "top", "tops"]):
        machine = spelling.Acceptor(sorted(words))
        reached, stack, said = set(), [(0, "")], []
        while stack:
            state, text = stack.pop()
            reached.add(state)
            said += [text] * machine.final[state]
            stack += [(to, text + c) for c, to in machine.arcs[state].items()]
        assert sorted(said) == sorted(words)
        rests = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in [*words, ""] for p in [w[:k] for k in range(len(w) + 1)]}
        assert len(reached) == len(rests)


def test_odd_rows(spark, odd, none):
    assert spelling.variants(none).collect() == []
    assert rows_of(spelling.variants(odd)) == {}
    rows = [(None, "Straße STRAßE straße straße straße"), (1, None), (2, "éàÉÀaz " * 7), (2, "éàÉÀaz " * 7), (3, "×÷×÷×÷ " * 5), (4, "x" * 100000 + " " + "longest " * 40000)]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == by_all_pairs(vocabulary(rows))
