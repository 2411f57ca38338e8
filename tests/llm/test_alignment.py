"""Alignment against a loop over bytes: which token of either side covers each byte of a text."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tidemark.llm import alignment, queries

TEXTS = ["plain words, twice: plain words", "naïve façade — 漢字 😀 ‚quotes‘", "a▁b", "nul\x00here", "<|endoftext|> <s> <unk> <0x41>", " ", "\n\n\t x  y   z", "́combining", "ﬁ ligature ½", "x" * 3000, "mixed 漢 " * 400]


def plain(texts):
    """(text -> expected row) by bytes, for texts as given, with corpus counts over all of them."""
    (encode_a, table_a), (encode_b, table_b) = alignment.byte_level(alignment.BPE), alignment.piece_level(alignment.PIECES)
    rows, count = [], Counter()
    for text in texts:
        whole = b" " + text.encode() if text else b""
        a, b = (encode_a([" " + text])[0], encode_b([text])[0]) if text else ([], [])
        if b"".join(table_a[x] for x in a) != whole or b"".join(table_b[x] for x in b) != whole:
            a = b = []
            whole = b""
        cover_a = [k for k, x in enumerate(a) for _ in table_a[x]]
        cover_b = [k for k, x in enumerate(b) for _ in table_b[x]]
        links = sorted(set(zip(cover_a, cover_b)))
        groups, at = [], 0
        for k in range(len(whole)):
            if k + 1 == len(whole) or (cover_a[k] != cover_a[k + 1] and cover_b[k] != cover_b[k + 1]):
                groups.append(([a[i] for i in sorted(set(cover_a[at : k + 1]))], [b[i] for i in sorted(set(cover_b[at : k + 1]))]))
                at = k + 1
        rows.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
        count.update(rows[-1][3])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    for a, b, groups, links in rows:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if a else ""
        yield len(a), len(b), len(groups), len(links), digest, sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links)


def found(docs, block_bytes=alignment.BLOCK_BYTES):
    rows = alignment.align(docs, block_bytes=block_bytes).withColumn("digest", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    out = alignment.stored_score(rows)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "n_best", "count_sum").collect()


@pytest.mark.parametrize("block_bytes", [1, 2000, alignment.BLOCK_BYTES])
def test_against_bytes(spark, block_bytes):
    want = {k: r for k, r in enumerate(plain(TEXTS))}
    assert {r[0]: tuple(r[1:]) for r in found(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3), block_bytes)} == want
    assert want[2][0] == 0 and want[4][0] > 0  # a text that holds the mark for space itself; special tokens as plain text


def test_odd_rows(odd, none):
    """Every row comes back, null and repeated doc_ids too, and other columns are not read."""
    texts = [r[0] or "" for r in odd.select("text").collect()]
    want = sorted(zip((repr(r[0]) for r in odd.select("doc_id").collect()), plain(texts)))
    assert sorted((repr(r[0]), tuple(r[1:])) for r in found(odd)) == want
    assert found(none) == []


def test_query_over_the_table(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    want = dict(zip([r[0] for r in rows], plain([r[1] for r in rows])))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = queries.op12_alignment(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in got.collect()} == want


def test_slices_of_several_tokens_on_both_sides():
    import numpy as np

    ends_a, ends_b = np.array([2, 4, 9, 10, 12]), np.array([1, 3, 4, 6, 8, 11, 12])
    cut_a, cut_b = alignment.cuts(ends_a, ends_b)
    assert (cut_a.tolist(), cut_b.tolist()) == ([1, 4], [2, 6])
    a, b = alignment.links(ends_a, ends_b, cut_a, cut_b)
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 5), (4, 5), (4, 6)]


def test_vocabulary_bytes_are_a_bijection():
    assert sorted(alignment.byte_alphabet().values()) == list(range(256))
