import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidemark.llm import packing


def reference_ids(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 0], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def whole(rows, ids):
    """Every id in one piece, sequences gapless and at most 1024."""
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    for key, token in ids.items():
        at = 0
        for start, n, crc, total in sorted(docs[key]):
            assert start == at and total == len(token)
            assert zlib.crc32(token[start : start + n].tobytes()) == crc
            at += n
        assert at == len(token)
    return bins


def test_round_trip_against_tokenizers(docs):
    rows = docs.select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in rows], reference_ids([r.text or "" for r in rows])))
    packed = packing.pack(docs).collect()
    bins = whole(packed, ids)
    used = sum(map(len, ids.values()))
    padded = sum(1024 - n if n & (n - 1) else 0 for n in (sum(x[1] for x in b) for b in bins.values()))
    assert padded < 0.01 * used
    assert {r.doc_id for r in packed} == set(ids)


def test_padding_and_cuts(docs):
    """Hardly any padding, and few more pieces than documents of more than a sequence need."""
    ids = reference_ids([r.text or "" for r in docs.collect()]) * 5
    pieces = []
    packer = packing.Packer(lambda document, start, part, sequence, offset: pieces.append((document, start, len(part), sequence)))
    for i, token in enumerate(ids):
        packer.add(i, token)
    packer.finish()
    fill = defaultdict(int)
    for _, _, n, sequence in pieces:
        fill[sequence] += n
    used = sum(map(len, ids))
    assert sum(1024 - n if n & (n - 1) else 0 for n in fill.values()) < 0.005 * used
    assert len(pieces) < sum(-(-len(x) // 1024) for x in ids) + len(fill)


def test_every_bin_holds_its_class_count():
    """Bins closed before the end hold the k whole documents of their class and one cut piece at most."""
    rng = np.random.default_rng(1)
    closed = []
    packer = packing.Packer(lambda *x: closed.append(x))
    lengths = rng.integers(1, 1024, 3000)
    for i, n in enumerate(lengths):
        packer.add(i, np.zeros(n, "<u4"))
    bins = defaultdict(list)
    for i, start, ids, sequence, _ in closed:
        bins[sequence].append((start, len(ids), len(ids) == lengths[i]))
    for parts in bins.values():
        k = 1024 // max(n for _, n, whole in parts if whole) if any(w for *_, w in parts) else 0
        assert sum(w for *_, w in parts) >= k and sum(not w for *_, w in parts) <= 3
        assert 1024 - packing.LEAST < sum(n for _, n, _ in parts) <= 1024


def test_special_tokens_are_those_of_tokenizers(spark):
    texts = ["x <|endoftext|> y", "<|endoftext|><|endoftext|>", "<|endoftext |>", None, "a\x00b <|endoftext|>"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ids=True).collect()
    for i, token in enumerate(reference_ids([x or "" for x in texts])):
        assert sum([r.ids for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)], []) == token.tolist()


def test_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    assert sorted(r.doc_tokens for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * reference_ids(["one"])[0].size
    assert any(r.doc_id is None for r in rows)
    assert packing.pack(none).count() == 0


def test_ids_come_along(docs):
    for r in packing.pack(docs.limit(20), ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
