"""Benchmark decontamination by a stored positional inverted index of the training texts.

`build_index` writes the index as a table: for every term of every segment (texts of about SEGMENT_BYTES) the sorted word
numbers where it stands, and one row for each text.  A segment is indexed by the task that reads its texts, so building
shuffles nothing however common a term is, and one index serves any number of benchmarks.

`search` takes a benchmark's windows in blocks of about `block_windows`, one block after another, each result written before the
next begins.  A block's terms are counted over the whole index, so the rarest term of a window is the rarest of the corpus.
The postings of the block's terms are dealt by segment; there a window starts from the places of its rarest term, and the
other terms' offset-adjusted lists are intersected with the places that are left, rarest first.  With slop 0 the match is the exact
phrase; else every term must stand within `slop` words of its place relative to the rarest one, in the same text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import ALNUM, new_name, partitions, shared_folder, slices, word_hashes

WINDOW = 10
SEGMENT_BYTES = 8 << 20
#: Bytes of a segment whose words are hashed at once.
HASH_BYTES = 1 << 20
#: Windows of a block.  Its index takes 40 bytes a window, its terms 80 at most, and its items their names.
BLOCK_WINDOWS = 1 << 17
#: Candidate positions tested at once.
CHUNK = 1 << 20

SPANS = "spans array<struct<start:long,end:long>>"


def _hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of a segment's texts, HASH_BYTES of them at a time: hashing takes many times the bytes."""
    hashes, first, a = [], [np.zeros(1, np.int64)], 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + HASH_BYTES, "right")) - 1)
        h, at = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a], ALNUM, lower=True)
        hashes.append(h)
        first.append(at[1:] + first[-1][-1])
        a = b
    return np.concatenate(hashes), np.concatenate(first)


def build_index(docs: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of docs(doc_id, text), written to path (a new folder beside the checkpoints if None) and read again.

    Rows with a term: segment, term, n and positions (word numbers in the segment, 32 bits each).  Rows without one: segment, place (the text's number
    there), doc_id, name (a hash of the text) and n (its words).  Null is empty.  A text of more than segment_bytes is a segment of its own.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, data, off in slices(batch, 2, segment_bytes):
                h, first = _hashes(data, off)
                order = np.argsort(h, kind="stable").astype(np.int32)
                h = h[order]
                begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                ends = (np.append(begin, len(h)) * 4).astype(np.int32)
                n, m = len(begin), b - a
                positions = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(order)])
                columns = [
                    pa.array(np.full(m + n, segment)),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(h[begin].view(np.int64))]),
                    pa.array(np.concatenate([np.diff(first), np.diff(ends) // 4])),
                    pa.concat_arrays([pa.nulls(m, pa.binary()), positions]),
                    pa.concat_arrays([pa.array(np.arange(m)), pa.nulls(n, pa.int64())]),
                    pa.concat_arrays([batch.column(0).slice(a, m), pa.nulls(n, batch.column(0).type)]),
                    pa.concat_arrays([batch.column(1).slice(a, m), pa.nulls(n, pa.int64())]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", "positions", "place", "doc_id", "name"])
                segment += 1

    path = path or f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text), text).mapInArrow(run, f"segment long, term long, n long, positions binary, place long, doc_id {kind}, name long")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item and w (term hashes) of every distinct window of the benchmark's items: `window` consecutive words, or all of an item of fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in slices(batch, 1):
                h, first = word_hashes(data, off, ALNUM, lower=True)
                size = np.diff(first)
                count = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
                who = np.repeat(np.arange(b - a), count)
                start = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                length = np.minimum(size[who], window)
                ends = np.concatenate([[0], np.cumsum(length)])
                values = h[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who + a)), lists], names=["item", "w"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item string, w array<long>").distinct()


def block_index(items: list[str], lengths: np.ndarray, values: np.ndarray, window: int = WINDOW) -> dict:
    """The distinct windows of a block: term numbers (-1 beyond the length), and the items of each.

    lengths and values give the windows' term hashes, one window for each of `items`.
    """
    terms = np.unique(values)
    table = np.full((len(lengths), window), -1, np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.searchsorted(terms, values)
    table, which = np.unique(table, axis=0, return_inverse=True)
    names, named = np.unique(np.array(items, object), return_inverse=True)
    order = np.lexsort((named, which.ravel()))
    first = np.searchsorted(which.ravel()[order], np.arange(len(table) + 1))
    return {"terms": terms, "table": table, "length": (table >= 0).sum(1), "names": names.tolist(), "items": named[order], "first": first}


def ranked(index: dict, count: np.ndarray) -> dict:
    """Adds ranks: the places of each window's terms, the rarest of the corpus first, from the terms' numbers of places there; a window with a term that the corpus lacks is not alive."""
    freq = np.where(index["table"] >= 0, count[index["table"]], np.iinfo(np.int64).max)
    return index | {"ranks": np.argsort(freq, axis=1, kind="stable").astype(np.int8), "alive": freq.min(1) > 0}


def match(index: dict, term: np.ndarray, position: np.ndarray, first: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first position, last position) of every match in a segment.

    term and position are the segment's postings, by term number and position; first gives each text's first word, with the total at the end.  With
    slop, one match is returned for each place of the rarest term.
    """
    table, length, ranks = index["table"], index["length"], index["ranks"]
    none = np.zeros(0, np.int64)
    if not len(table) or not len(term):
        return none, none, none
    size = int(first[-1]) + 1
    key = term.astype(np.int64) * size + position
    here = np.bincount(term, minlength=len(index["terms"]))
    begin = np.concatenate([[0], np.cumsum(here)])
    live = np.flatnonzero(index["alive"] & (np.where(table >= 0, here[table], 1).min(1) > 0))
    rare = table[np.arange(len(table)), ranks[:, 0]]
    todo = here[rare[live]]
    ends = np.cumsum(todo)
    text = np.searchsorted(first, position, "right") - 1
    out = []
    a = 0
    while a < len(live):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        w = np.repeat(live[a:b], todo[a:b])
        k = np.arange(len(w)) - np.repeat(ends[a:b] - todo[a:b] - base, todo[a:b])
        at = begin[rare[w]] + k
        hit, start = position[at].astype(np.int64), position[at] - ranks[w, 0].astype(np.int64)
        head, tail = first[text[at]], first[text[at] + 1]
        low, high = hit, hit
        if not slop:
            ok = (start >= head) & (start + length[w] <= tail)
            w, start, head, tail = w[ok], start[ok], head[ok], tail[ok]
            low, high = start, start + length[w] - 1
        for j in range(1, table.shape[1]):
            if not len(w):
                break
            offset = ranks[w, j]
            t = table[w, offset].astype(np.int64)
            want = start + offset
            probe = t * size + (np.maximum(want - slop, head) if slop else want)
            near = key[np.minimum(np.searchsorted(key, probe), len(key) - 1)]
            pos = near - t * size
            ok = (t < 0) | ((near >= probe) & (pos <= want + slop) & (pos < tail))
            if slop:
                pos = np.where(t < 0, low, pos)
                low, high = np.minimum(low, pos), np.maximum(high, np.where(t < 0, high, pos))
            w, start, head, tail, low, high = (x[ok] for x in (w, start, head, tail, low, high))
        out.append((w, low, high))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _structs(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPANS)


def _matcher(broadcast, slop: int):
    """Rows (segment, term, n, positions), sorted by segment and term, text rows (without a term) first, to the texts that match."""

    def found(segment: int, sizes: list[int], terms: list[int], postings: list[bytes]) -> pa.RecordBatch | None:
        index = broadcast.value
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        number = np.searchsorted(index["terms"], np.array(terms, np.int64))
        term = np.repeat(number, [len(x) // 4 for x in postings])
        w, low, high = match(index, term, np.frombuffer(b"".join(postings), np.int32), first, slop)
        if not len(w):
            return None
        place = np.searchsorted(first, low, "right") - 1
        order = np.argsort(place, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) > 0]))
        texts, spans, items = place[order][cut], [], []
        for part in np.split(order, cut[1:]):
            base = first[place[part[0]]]
            spans.append(_merge(list(zip((low[part] - base).tolist(), (high[part] - base + 1).tolist()))))
            held = np.unique(np.concatenate([index["items"][index["first"][x] : index["first"][x + 1]] for x in np.unique(w[part])]))
            items.append([index["names"][x] for x in held])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), segment)), pa.array(texts), _structs(spans), pa.array(items, pa.list_(pa.string()))], names=["segment", "place", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sizes, terms, postings = None, [], [], []
        for batch in batches:
            segments = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), len(segments)] if len(segments) else []
            for a, b in zip(edges, edges[1:]):
                if segments[a] != now:
                    if postings and (x := found(now, sizes, terms, postings)) is not None:
                        yield x
                    now, sizes, terms, postings = int(segments[a]), [], [], []
                part = batch.slice(a, b - a)
                texts = part.column(1).null_count
                sizes += part.column(2).slice(0, texts).to_pylist()
                terms += part.column(1).slice(texts).to_pylist()
                postings += part.column(3).slice(texts).to_pylist()
        if postings and (x := found(now, sizes, terms, postings)) is not None:
            yield x

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of the blocks' spans and items of each text to one list of each."""
    for batch in batches:
        spans = [_merge([(x["start"], x["end"]) for part in r for x in part]) for r in batch.column(2).to_pylist()]
        items = [sorted({x for part in r for x in part}) for r in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _structs(spans), pa.array(items, pa.list_(pa.string()))], names=["segment", "place", "spans", "items"])


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, name, n_words, spans (merged word ranges [start, end) inside a match) and items (ids that match, sorted as strings) of every indexed text."""
    spark = index.sparkSession
    folder = f"{shared_folder(spark)}/matches-{uuid.uuid4().hex}"
    phrases(benchmark, window).write.parquet(f"{folder}/windows")
    windows = spark.read.parquet(f"{folder}/windows")
    blocks = -(-windows.count() // block_windows) or 1
    postings, texts = index.where("term is not null"), index.where("term is null")
    order = [F.col("segment"), F.col("term").asc_nulls_first(), F.col("place")]
    results = []
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("w", "item"), F.lit(blocks)) == block).toArrow()
        lists = part.column("w").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
        built = block_index(part.column("item").to_pylist(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), window=window)
        wanted = F.broadcast(spark.createDataFrame(pa.table({"term": built["terms"]})))  # ten for each window of the block at most
        counts = postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        count = np.zeros(len(built["terms"]), np.int64)
        count[np.searchsorted(built["terms"], counts.column("term").to_numpy())] = counts.column("n").to_numpy()
        held = spark.sparkContext.broadcast(ranked(built, count))
        rows = postings.join(wanted, "term", "left_semi").select("segment", "term", "n", "positions", "place").unionByName(texts.select("segment", "term", "n", "positions", "place"))
        dealt = rows.repartition(partitions(spark), "segment").sortWithinPartitions(*order)
        dealt.mapInArrow(_matcher(held, slop), f"segment long, place long, {SPANS}, items array<string>").write.parquet(f"{folder}/{block}")
        held.destroy()
        results.append(spark.read.schema(f"segment long, place long, {SPANS}, items array<string>").parquet(f"{folder}/{block}"))
    found = reduce(DataFrame.unionByName, results).groupBy("segment", "place").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    found = found.mapInArrow(_merged, f"segment long, place long, {SPANS}, items array<string>")
    none = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", "array<struct<start:bigint,end:bigint>>"), ("items", "array<string>"))]
    return texts.select("segment", "place", "doc_id", "name", F.col("n").alias("n_words")).join(found, ["segment", "place"], "left").select("doc_id", "name", "n_words", *none)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, name, n_words, spans and items of every row of docs, as search gives them.

    Null and empty texts have no words; a very long text is a segment of its own.  Benchmark rows with null text match nothing; a null item_id is
    reported as "".  Repeated rows on either side are kept and found alike; other columns are not read; an empty table gives no rows.
    """
    return search(build_index(docs), benchmark, window, slop, block_windows)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any match, with all their own columns; rows are told apart by doc_id and text."""
    bad = benchmark_matches(docs, benchmark, **options).where(F.size("spans") > 0)
    one, two = new_name("doc", docs), new_name("name", docs)
    bad = bad.select(F.col("doc_id").alias(one), F.col("name").alias(two)).distinct()
    same = docs["doc_id"].eqNullSafe(bad[one]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad[two])
    return docs.join(bad, same, "left_anti")
