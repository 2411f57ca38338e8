"""Harmonic packing of token sequences.

A document of more than the capacity first gives pieces of the whole capacity.  What is left of length n belongs to
class k = capacity // n, and every bin of class k takes exactly k whole documents, so that a bin is closed by a count alone
and workers fill the bins of their own documents without asking each other: no row is shuffled.  k such documents leave a
gap below a (k + 1)th of the capacity.  A small reserve of documents fills it: whole ones that fit, largest first, and then
one cut to the size of the gap, so a bin costs one cut at most and closes within `least` ids of the capacity.

At the end of a task the open bins and the reserve, whose size the capacity bounds, are laid end to end in sequences of the
capacity; the last one, shorter, is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY, LEAST, END = 1024, 16, 0
#: Capacities that the reserve of a task may hold before documents go to their classes.
RESERVE = 16
BPE = public_tokenizers.path("byte_bpe_50k.json")

_encoders: dict[str, object] = {}


def encoder(path: str):
    """A function text -> ids: those of tokenizers for the .json file, without the special tokens that it adds around a text.

    Texts without any of the vocabulary's added tokens are encoded by tiktoken through the rank file of the same vocabulary
    beside it, if there is one: the same ids in a quarter of the time.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def plain(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        _encoders[path] = plain
        if path.endswith("byte_bpe_50k.json"):
            import tiktoken

            with open(path, encoding="utf-8") as file:
                added = [x["content"] for x in json.load(file)["added_tokens"]]
            with open(path.removesuffix(".json") + ".tiktoken", "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _encoders[path] = lambda text: plain(text) if any(x in text for x in added) else fast(text)
    return _encoders[path]


class Packer:
    """Packs documents, one after another, into sequences numbered from 0; `emit` gets (document, start, ids, sequence, offset) of every piece."""

    def __init__(self, emit, capacity: int = CAPACITY, least: int = LEAST, reserve: int = RESERVE) -> None:
        self.emit, self.capacity, self.least, self.most = emit, capacity, least, reserve * capacity
        self.open: dict[int, list[tuple]] = {}
        self.reserve: list[tuple] = []  # (length, number, document, start, ids) by length
        self.held = self.number = self.sequence = 0

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            self._close([(document, a, ids[a : a + self.capacity])])
        if whole == len(ids):
            return
        rest = (document, whole, ids[whole:])
        if self.held < self.most:
            self._keep(rest)
            return
        k = self.capacity // len(rest[2])
        bin = self.open.setdefault(k, [])
        bin.append(rest)
        if len(bin) == k:
            del self.open[k]
            self._fill(bin)

    def finish(self) -> None:
        """Packs what is still open."""
        left = [x for k in sorted(self.open) for x in self.open[k]] + [x[2:] for x in reversed(self.reserve)]
        self.open, self.reserve, self.held = {}, [], 0
        room, bin = self.capacity, []
        total = sum(len(x[2]) for x in left)
        for document, start, ids in left:
            while len(ids):
                if room == self.capacity and total < self.capacity:
                    room = 1 << (total.bit_length() - 1)
                n = min(room, len(ids))
                bin.append((document, start, ids[:n]))
                start, ids, room, total = start + n, ids[n:], room - n, total - n
                if not room:
                    self._close(bin)
                    room, bin = self.capacity, []

    def _keep(self, piece: tuple) -> None:
        insort(self.reserve, (len(piece[2]), self.number, *piece), key=lambda x: x[:2])
        self.number += 1
        self.held += len(piece[2])

    def _fill(self, bin: list[tuple]) -> None:
        gap = self.capacity - sum(len(x[2]) for x in bin)
        while gap >= self.least and self.reserve:
            at = bisect_right(self.reserve, gap, key=lambda x: x[0]) - 1
            n, _, document, start, ids = self.reserve.pop(at)  # the longest that fits, or else the longest of all
            self.held -= n
            take = min(gap, n)
            bin.append((document, start, ids[:take]))
            gap -= take
            if take < n:
                self._keep((document, start + take, ids[take:]))
        self._close(bin)

    def _close(self, bin: list[tuple]) -> None:
        offset = 0
        for document, start, ids in bin:
            self.emit(document, start, ids, self.sequence, offset)
            offset += len(ids)
        self.sequence += 1


def pack(docs: DataFrame, tokenizer: str = BPE, capacity: int = CAPACITY, least: int = LEAST, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset (and ids if asked for) of every piece.

    capacity must be a power of two.  Null and empty texts are the single id 0.  A very long text is encoded whole and cut
    into full sequences.  Repeated rows are packed each on its own; other columns are not read.  An empty table gives no
    rows.  Sequence ids are unique (the task's number and the place in it) with gaps between tasks.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        out: list[tuple] = []
        base = TaskContext.get().partitionId() << 40

        def emit(document, start, part, sequence, offset):
            doc_id, total = document
            out.append((doc_id, start, len(part), zlib.crc32(part), total, base + sequence, offset, *[part.astype(np.int32)] * ids))

        def batch(schema: pa.DataType) -> pa.RecordBatch:
            columns = [list(x) for x in zip(*out)] or [[] for _ in names]
            out.clear()
            kinds = [schema, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * ids]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

        packer, schema = Packer(emit, capacity, least), None
        for rows in batches:
            schema = rows.schema.field(0).type
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                token = np.array([*encode(text.as_py() or ""), END], "<u4")
                packer.add((doc_id, len(token)), token)
                if len(out) >= 1 << 14:
                    yield batch(schema)
        packer.finish()
        if out:
            yield batch(schema)

    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(run, fields)
