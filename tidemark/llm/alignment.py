"""Alignment of two tokenizers' ids on the same texts.

Each text is encoded twice.  The byte offsets at which tokens end go into one dictionary end -> index for each side; the ends
that both dictionaries hold, in order, are the cuts, and they slice both id lists into groups that cover the same bytes.
Within a slice, the links are the pairs of tokens whose bytes overlap.

A document carries its distinct linked id pairs and how often each occurs.  Documents come in blocks of bounded text, and a
block's pairs are added up before they are shuffled, so that a pair that every document holds is one row a block.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import checkpoint, delete_folder, shared_folder
from tidemark.llm.packing import BPE

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Texts encoded by one call hold about so many bytes.
CALL_BYTES = 1 << 18
#: A link's pair of ids is one long: id of A times this, plus id of B.
SIDE = 1 << 32

LINKS = "n_a long, n_b long, n_groups long, n_links long, groups string, block long, pairs array<long>, times array<long>"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str):
    """(texts -> lists of ids, bytes of every id) of a byte-level BPE in tokenizers' JSON; special tokens in a text are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as file:
        special = {x["id"] for x in json.load(file)["added_tokens"]}
    table = [b""] * tokenizer.get_vocab_size()
    for token, k in tokenizer.get_vocab().items():
        table[k] = token.encode() if k in special else bytes(alphabet[c] for c in token)

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    ranks = path.removesuffix(".json") + ".tiktoken"
    if path.endswith("byte_bpe_50k.json"):  # tiktoken gives the same ids of the same vocabulary in a quarter of the time
        import base64

        import tiktoken

        with open(ranks, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(texts: list[str]) -> list[list[int]]:  # noqa: F811
            return [fast(x) for x in texts]

    return encode, table


@lru_cache(maxsize=2)
def piece_level(path: str):
    """(texts -> lists of ids, bytes of every id) of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k in range(model.vocab_size()) for p in [model.id_to_piece(k)]]
    return (lambda texts: model.encode(texts, num_threads=1)), table


class Side:
    """What one tokenizer's ids need: their bytes, their lengths, and their digits followed by each separator."""

    def __init__(self, table: list[bytes], last: str) -> None:
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.length = np.array([len(b) for b in table], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.inner = np.array([f"{k}," for k in range(len(table))], object)
        self.last = np.array([f"{k}{last}" for k in range(len(table))], object)


    def spells(self, ids: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> bool:
        """Whether the tokens' bytes are these."""
        if (ends[-1] if len(ends) else 0) != len(whole):
            return False
        length = self.length[ids]
        return bool((self.bytes[np.arange(len(whole)) + np.repeat(self.start[ids] - ends + length, length)] == whole).all())


def cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place where a token of A and one of B both end: the index of either, in order."""
    at_a = dict(zip(ends_a.tolist(), range(len(ends_a))))
    at_b = dict(zip(ends_b.tolist(), range(len(ends_b))))
    common = [e for e in at_a if e in at_b]  # in the order of A's ends, which is theirs
    return np.fromiter(map(at_a.__getitem__, common), np.int64, len(common)), np.fromiter(map(at_b.__getitem__, common), np.int64, len(common))


def links(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of every linked pair of tokens, slice after slice.

    Tokens of a slice tile the same bytes on both sides and share no end before its last, so its merged ends are a staircase:
    each end closes one link, and then the side whose token ended, or both at a cut, goes one on.
    """
    own_b = np.ones(len(ends_b), bool)
    own_b[cut_b] = False
    shared = np.zeros(len(ends_a) + int(own_b.sum()), bool)
    shared[cut_a] = True
    order = np.argsort(np.concatenate([ends_a, ends_b[own_b]]), kind="stable")
    of_a = order < len(ends_a)
    of_b = ~of_a | shared[order]
    return np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b


def _digits(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, one: Side, two: Side) -> str:
    """`a1,a2|b1;a3|b2,b3`: the groups' ids in order."""
    out = np.empty(len(a) + len(b), object)
    for ids, cut, other, side, shift in ((a, cut_a, cut_b, one, -1), (b, cut_b, cut_a, two, 0)):
        words = side.inner[ids]
        words[cut] = side.last[ids[cut]]
        group = np.repeat(np.arange(len(cut)), np.diff(cut, prepend=-1))
        done = np.append(other + 1, 0)  # tokens of the other side in the groups up to each; none before the first
        out[np.arange(len(ids)) + done[group + shift]] = words
    return "".join(out.tolist())[:-1]


def align_text(text: str, a: list[int], b: list[int], one: Side, two: Side) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray] | None:
    """(n_a, n_b, n_groups, n_links, groups, pairs ascending, times of each); None if either side's bytes are not the text's."""
    whole = np.frombuffer(b" " + text.encode(), np.uint8)
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    ends_a, ends_b = np.cumsum(one.length[a]), np.cumsum(two.length[b])
    if not (one.spells(a, ends_a, whole) and two.spells(b, ends_b, whole)):
        return None
    cut_a, cut_b = cuts(ends_a, ends_b)
    at_a, at_b = links(ends_a, ends_b, cut_a, cut_b)
    pairs, times = np.unique(a[at_a] * SIDE + b[at_b], return_counts=True)
    return len(a), len(b), len(cut_a), len(at_a), _digits(a, b, cut_a, cut_b, one, two), pairs, times


def align(docs: DataFrame, tokenizer_a: str = BPE, tokenizer_b: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, the numbers of tokens, groups and links, `groups` (`a1,a2|b1;a3|b2,b3`), block, and the document's distinct linked
    pairs (id of A times SIDE plus id of B) with their times: one row for each row of docs, without a shuffle.

    Null and empty texts, and texts that a tokenizer changes, have zeros, an empty string and empty lists.  A very long text is
    encoded whole.  Rows of equal or null doc_id are each aligned on their own; other columns are not read; an empty table gives
    no rows.  block is unique to a task and a run of its documents.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, table_a), (encode_b, table_b) = byte_level(tokenizer_a), piece_level(tokenizer_b)
        one, two = Side(table_a, "|"), Side(table_b, ";")
        block, filled = TaskContext.get().partitionId() << 32, 0
        for rows in batches:
            if not len(rows):
                continue
            texts = rows.column(1).to_pylist()
            size = np.cumsum([len(t or "") for t in texts])
            begin = 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + CALL_BYTES, "right")))
                part = [t or "" for t in texts[begin:end]]
                found = []
                for text, a, b in zip(part, encode_a([" " + t for t in part]), encode_b(part)):
                    n = len(text.encode())
                    if filled and filled + n > block_bytes:
                        block, filled = block + 1, 0
                    filled += n
                    got = align_text(text, a, b, one, two) if text else None
                    found.append((*(got[:5] if got else (0, 0, 0, 0, "")), block, *(got[5:] if got else (np.zeros(0, np.int64),) * 2)))
                columns = list(zip(*found))
                arrays = [rows.column(0).slice(begin, end - begin), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64())]
                off = np.cumsum([0, *map(len, columns[6])])
                arrays += [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(c), pa.int64())) for c in columns[6:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "block", "pairs", "times"])
                begin = end

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {LINKS}")


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((block, pair) of every pair in a block, (pair, count, best) over all blocks); best if no pair of the same B id has more."""
    held = aligned.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("block", F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    count = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % SIDE)
    most = count.groupBy("b").agg(F.max("count").alias("most"))
    return held.select("block", "pair"), count.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score(aligned: DataFrame) -> DataFrame:
    """The columns of aligned but for pairs and times, with n_best (links whose count is the highest of their B id) and count_sum.

    aligned is read twice and should be stored (`stored_score` does both).  A block's rows meet its own pairs in one group, whose size BLOCK_BYTES bounds
    (or one text, if that is longer).
    """
    held, counts = pair_counts(aligned)
    known = held.join(counts, "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        pair, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        pair, count, best = pair[order], count[order], best[order]
        lists = rows.column("pairs").combine_chunks()
        at = np.searchsorted(pair, lists.flatten().to_numpy())
        times = rows.column("times").combine_chunks().flatten().to_numpy()
        ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
        sums = [total(times * best[at]), total(times * count[at])] if len(pair) else [np.zeros(len(rows), np.int64)] * 2
        out = rows.select(kept)
        for name, values in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return aligned.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(look_up, f"{fields}, n_best long, count_sum long")


def stored_score(aligned: DataFrame) -> DataFrame:
    """`score` of rows that are written to the shared folder first, so that texts are encoded once even if executors are lost; the folder goes when the scores are checkpointed."""
    spark = aligned.sparkSession
    path = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    try:
        aligned.write.option("compression", "zstd").parquet(path)
        return checkpoint(score(spark.read.parquet(path)))
    finally:
        delete_folder(spark, path)
