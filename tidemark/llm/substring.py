"""Removal of word spans that occur in earlier documents, by suffix automata of reference shards.

The reference of a document is every document with a smaller id, so a broadcast automaton of all of it has no size
bound.  The reference is therefore cut into shards that belong together, and each document streams only through the
shards that can match it:

1. Anchors.  Of each window of `window` words, the least hash of its GRAM-word sequences is its anchor.  Equal windows
   have equal anchors, and neighbouring windows mostly share one, so about two sevenths of the words suffice.  Anchors seen in
   one document only are dropped; the others get a leader, the document that has them and comes first by a hash.
2. Regions.  The windows of a document with a shared anchor form regions, each sent, as words, to the shard of its
   anchors: SPAN words of their leader.  All documents with a window send it to the same shard.
3. Shards.  A shard streams its documents in order of their ids through its automaton, which holds the regions of all smaller
   ones.  The matching statistics mark every span of `window` words or more; what did not match is then added, so copies add nothing.
4. Rounds.  Where more than FAN documents share an anchor, its shard is dealt into parts of about FAN documents, each with an automaton of
   its own.  A window that a smaller document of its part has is settled there.  The others - the first of each part, and
   those that only look alike, such as the surroundings of a common line - go on one by one, each to the shard of its own words, where it meets the
   other parts' (in parts again, if there are very many).  A copy that meets its like in the same slice of a task is settled at once.
   So a task holds FAN documents' regions of SPAN words, or a window of one document of each part, however often a text is copied.

`remove_reference_spans` is the plain form for a given reference of bounded size: its automata are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import NON_SPACE, mix, new_name, partitions, slices, span_hash, word_hashes, words
from tidemark.llm.automaton import SuffixAutomaton

WINDOW, GRAM = 13, 6
#: Words of a leader that make a shard, shards of a leader at most, and documents of a part.
SPAN, PARTS, FAN = 4096, 1 << 20, 512
#: Regions take a round, windows of parted shards another, and a third where they come from more than 2^MANY parts.
ROUNDS, MANY = 3, 9
#: Anchors only propose; 48 bits keep the shuffles small.
ANCHOR_BITS = 48


def anchors(h: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, text, anchor) of every window of the texts; h holds the hashes of their words."""
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.arange(len(h) - gram + 1)
    low = span_hash(h, at, at + gram) >> np.uint64(64 - ANCHOR_BITS)
    span, step = window - gram + 1, 1
    while step < span:  # least of `span` neighbours, by doubling
        move = min(step, span - step)
        low = np.minimum(low[: len(low) - move], low[move:])
        step += move
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return start, doc[start], low[start].view(np.int64)


def _anchor_rows(keyed: DataFrame, window: int, span: int) -> DataFrame:
    """h, doc_id and place of the anchors of keyed(key, text), once for each run of windows.

    place orders documents by a hash (44 bits) and holds the number of the run's `span` words (20 bits), so that the least place of an anchor names a part
    of one document, the same for most of that part's anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column(0).to_numpy()
            for a, _, data, off in slices(batch, 1):
                h, first = word_hashes(data, off, NON_SPACE)
                start, doc, low = anchors(h, first, window)
                if len(low):
                    new = _run_starts(low, doc)
                    part = np.minimum((start[new] - first[doc[new]]) // span, PARTS - 1)
                    owner = owners[doc[new] + a]
                    place = (mix(owner.view(np.uint64)) >> np.uint64(20) << np.uint64(20)).view(np.int64) | part
                    yield pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(owner), pa.array(place)], names=["h", "doc_id", "place"])

    return keyed.mapInArrow(run, "h long, doc_id long, place long")


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(out)


def _composite(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return mix(anchor.astype(np.uint64) ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def text_name(raw: bytes) -> int:
    """Tells the texts of rows with the same doc_id apart."""
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


REGION = pa.schema([("rounds", pa.int8()), ("shard", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.binary())])


def _region_batch(rounds, shard, part, doc, name, start, stop, raw) -> pa.RecordBatch:
    """Rows of the region table.  rounds: how many a region still takes; 0 is a settled span, dealt by its document alone.  part: by the document, one of so many."""
    rounds, shard, part, doc, name, start, stop = (np.asarray(x, np.int64) for x in (rounds, shard, part, doc, name, start, stop))
    part = (mix(doc.view(np.uint64)) % part.astype(np.uint64)).view(np.int64)
    columns = [pa.array(rounds.astype(np.int8)), *(pa.array(x) for x in (np.where(rounds > 0, shard, doc), part, doc, name, start, stop)), pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=REGION)


def _region_rows(joined: DataFrame, window: int) -> DataFrame:
    """Rows (..., key, text, shared anchors) to the region table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            owners, column = batch.column(last - 2).to_numpy(), batch.column(last)
            offsets, parts = column.offsets.to_numpy(), column.values
            anchor, shard, level = (np.asarray(parts.field(i)) for i in range(3))
            for a, b, data, off in slices(batch, last - 1):
                begin, end, first = words(data, off, NON_SPACE)
                start, doc, low = anchors(span_hash(data, begin, end), first, window)
                if not len(start):
                    continue
                x, y = offsets[a], offsets[b]
                given = _composite(np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), anchor[x:y])
                order = np.argsort(given)
                head = _run_starts(low, doc)
                want = _composite(doc[head], low[head])
                at = order[np.minimum(np.searchsorted(given, want, sorter=order), len(given) - 1)]
                size = np.diff(np.append(head, len(low)))
                c = np.flatnonzero(np.repeat(given[at] == want, size))
                if not len(c):
                    continue
                to, parted = np.repeat(shard[x:y][at], size)[c], np.repeat(level[x:y][at], size)[c]
                cut = _run_starts(c - np.arange(len(c)), to, parted, doc[c])
                p, q = c[cut], c[np.append(cut[1:], len(c)) - 1]
                s, e = start[p], start[q] + window
                raw = data.tobytes()
                text = [b" ".join(raw[i:j].split()) for i, j in zip(begin[s].tolist(), end[e - 1].tolist())]
                name = np.zeros(b - a, np.int64)
                for i in np.unique(doc[p]).tolist():
                    name[i] = text_name(raw[off[i] : off[i + 1]])
                owner, to, parted = owners[a + doc[p]], to[cut], parted[cut].astype(np.int64)
                least: dict[tuple, int] = {}  # of the slice's documents with the same region, the least goes on
                keys = list(zip(to.tolist(), parted.tolist(), text))
                for key, d in zip(keys, owner.tolist()):
                    least[key] = min(d, least.get(key, d))
                done = owner > np.array([least[key] for key in keys])
                left = np.where(done, 0, 1 + (parted > 0) + (parted > MANY))
                yield _region_batch(left, to, 1 << parted, owner, name[doc[p]], s - first[doc[p]], e - first[doc[p]], [None if x else t for x, t in zip(done.tolist(), text)])

    return joined.mapInArrow(run, "rounds tinyint, shard long, part long, doc_id long, text long, start long, stop long, words binary")


def _matched(stat: list[int], window: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(maximal spans of matched windows, spans of windows that did not match) from matching statistics."""
    hit: list[list[int]] = []
    rest: list[list[int]] = []
    for i in range(window - 1, len(stat)):
        to = hit if stat[i] >= window else rest
        s = i - window + 1
        if to and s <= to[-1][1]:
            to[-1][1] = i + 1
        else:
            to.append([s, i + 1])
    return hit, rest


class Shard:
    """One reference shard: an automaton of the regions of all documents so far."""

    def __init__(self, window: int) -> None:
        self.window, self.automaton = window, SuffixAutomaton()
        self.whole: set[bytes] = set()
        self.pending: list[tuple[bytes, list, list[tuple[int, int]]]] = []

    def settle(self) -> None:
        """Adds what the last document had anew."""
        for raw, sequence, rest in self.pending:
            for s, e in rest:
                self.automaton.add(sequence[s:e])
            self.whole.add(raw)
        self.pending = []

    def stream(self, raw: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list]:
        """(spans of a region that earlier documents have, spans with a window that they don't have, words)."""
        if raw in self.whole:
            return [(0, raw.count(b" ") + 1)], [], []
        sequence = raw.split(b" ")
        hit, rest = _matched(self.automaton.statistics(sequence), self.window)
        self.pending.append((raw, sequence, rest))
        return hit, rest, sequence


def _stream_shards(window: int):
    """A round: region rows sorted by (shard, part, rounds, doc_id, start), so that those of a part come together, to settled spans and the windows that the next round gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key, owner = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for left, to, part, d, name, s, e, raw in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if not left:
                    out.append((0, to, 1, d, name, s, e, None))
                    continue
                if (left, to, part) != key:
                    shard, key, owner = Shard(window), (left, to, part), d
                if d != owner:
                    shard.settle()
                    owner = d
                hit, rest, sequence = shard.stream(raw)
                out += [(0, to, 1, d, name, s + x, s + y, None) for x, y in hit]
                if left > 1:
                    parts = 1 << MANY if left > 2 else 1
                    for x, y in rest:
                        for i in range(x, y - window + 1):
                            one = b" ".join(sequence[i : i + window])
                            out.append((left - 1, text_name(one), parts, d, name, s + i, s + i + window, one))
            for a in range(0, len(out), 1 << 16):
                yield _region_batch(*zip(*out[a : a + (1 << 16)]))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with two columns behind the others: a key (doc_id, or the least long for null - never null, so that both joins on it read one exchange) and text, never null."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("doc_id must be an integer")
    own = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept")]
    return docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(new_name("key", docs)), F.coalesce("text", F.lit("")).alias("text"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """doc_id, text (the text's name), start, stop (word numbers) of spans whose windows also start in a document with a smaller doc_id.

    Spans of one document may overlap and repeat.  doc_id must be an integer; rows of null doc_id have no order, so
    they neither lose words nor take them from others.  Rows that repeat a doc_id are one document with several texts.
    """
    return _spans(_keyed(docs), window, span, fan)


def _spans(keyed: DataFrame, window: int, span: int, fan: int) -> DataFrame:
    key = keyed.columns[-2]
    seen = _anchor_rows(keyed.where("doc_id is not null").select(key, "text"), window, span)
    shared = seen.groupBy("h").agg(F.min("place").alias("shard"), F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count("*").alias("_n")).where("_first < _last")
    level = F.greatest(F.ceil(F.log2(F.col("_n") / fan)), F.lit(0)).cast("tinyint")
    # the anchor is rewritten (to itself), so that this small side of the join is dealt anew: Spark splits a hot anchor only then
    shared = shared.select(F.col("h").bitwiseXOR(F.lit(0)).alias("h"), "shard", level.alias("level"))
    lists = seen.select("h", "doc_id").join(shared, "h").groupBy("doc_id").agg(F.collect_set(F.struct("h", "shard", "level")).alias(new_name("shared", keyed)))
    rows = _region_rows(keyed.join(lists.withColumnRenamed("doc_id", name := new_name("id", keyed)), F.col(key) == F.col(name)).drop(name), window)
    order = ["shard", "part", "rounds"]
    for _ in range(ROUNDS):
        dealt = rows.repartition(partitions(keyed.sparkSession), *order).sortWithinPartitions(*order, "doc_id", "start")
        rows = dealt.mapInArrow(_stream_shards(window), rows.schema)
    return rows.select("doc_id", "text", "start", "stop")


def _cut():
    """Rows (columns..., text, spans): adds n_words, n_removed and kept, the words left, joined by one space.  Spans may begin with the name of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            texts = batch.column(last - 1).cast(pa.large_binary())
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(texts, batch.column(last)):
                raw = text.as_py() or b""
                w = raw.split()
                gone = np.zeros(len(w) + 1, np.int32)
                if spans.values is not None and len(spans.values):
                    *name, start, stop = (np.asarray(spans.values.field(i)) for i in range(spans.values.type.num_fields))
                    if name:
                        own = name[0] == text_name(raw)
                        start, stop = start[own], stop[own]
                    np.add.at(gone, start, 1)
                    np.add.at(gone, stop, -1)
                gone = np.cumsum(gone[:-1]) > 0
                n_words.append(len(w))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([x for x, g in zip(w, gone.tolist()) if not g] if gone.any() else w).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[: last - 1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names[: last - 1], "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """docs without text, with n_words, n_removed and kept (the words left, joined by one space).

    Null and empty texts have no words; a very long text is one document like any other, in regions of its own for each
    shard.  Repeated rows lose the same words and take none from each other.  doc_id must be an integer; rows without one
    lose nothing.  Columns named n_words, n_removed and kept are replaced, all others return; an empty table gives no rows.
    """
    keyed = _keyed(docs)
    key, own = keyed.columns[-2], keyed.columns[:-2]
    spans, name = new_name("spans", keyed), new_name("id", keyed)
    lists = _spans(keyed, window, span, fan).groupBy("doc_id").agg(F.collect_set(F.struct("text", "start", "stop")).alias(spans))
    joined = keyed.join(lists.withColumnRenamed("doc_id", name), F.col(key) == F.col(name), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in own], "text", F.when(F.col("doc_id").isNotNull(), F.col(spans)).alias(spans))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema.fields[:-2])
    return joined.mapInArrow(_cut(), f"{fields}n_words long, n_removed long, kept string")


def remove_reference_spans(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = 1 << 20, most_words: int = 1 << 22) -> DataFrame:
    """docs without text, with n_words, n_removed and kept: every maximal span of `window` words or more that the
    reference holds is removed.

    The reference's texts are dealt into shards of about `shard_words` words, and the shards' automata are broadcast.
    A reference of more than most_words words is refused (use remove_repeats, which needs no broadcast).
    """
    total = reference.agg(F.coalesce(F.sum(F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), ""))), F.lit(0))).first()[0]
    if total > most_words:
        raise ValueError(f"the reference has {total} words; at most {most_words} are broadcast")
    shards, used = [SuffixAutomaton()], 0
    for r in reference.where("text is not null").select("text").toLocalIterator():
        w = r.text.encode().split()
        if used + len(w) > shard_words and used:
            shards.append(SuffixAutomaton())
            used = 0
        shards[-1].add(w)
        used += len(w)
    held = docs.sparkSession.sparkContext.broadcast([(a.length, a.link, a.next) for a in shards])
    own = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept")]
    base = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce("text", F.lit("")).alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for parts in held.value:
            a = SuffixAutomaton()
            a.length, a.link, a.next = parts
            automata.append(a)

        def marked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = []
                for text in batch.column(batch.num_columns - 1).cast(pa.large_binary()):
                    w = text.as_py().split()
                    spans.append([{"start": s, "end": e} for a in automata for s, e in _matched(a.statistics(w), window)[0]])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, shape)], names=[*batch.schema.names, ""])

        yield from _cut()(marked())

    return base.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept string" if own else "n_words long, n_removed long, kept string")
