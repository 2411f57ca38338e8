"""SimHash fingerprints, linked through an inverted index of positional bytes with count filtering.

A 64-bit fingerprint is eight (position, byte) tokens.  Two fingerprints within three bits differ in at most three
bytes, so they share at least five of the eight tokens: the guaranteed minimum.  The index keeps its lists by the 56 choices of
five positions, since a list of one token would hold a 256th of the corpus: every pair with five shared tokens meets in
the list of five of them, and no other pair meets at all.  Inside a list the shared bytes of a pair are tallied and pairs with five or more are
verified by their differing bits, block after block.  A list holds distinct fingerprints only, and emits a spanning forest of their links, not the links.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._text import checkpoint, delete_folder, give_back, mix, new_name, partitions, shared_folder
from tidemark.llm.components import components

BYTES, MAX_BITS, SEED = 8, 3, 42
#: Every choice of as many positions as linked fingerprints share.
SETS = list(combinations(range(BYTES), BYTES - MAX_BITS))
#: Fingerprints of a list that are compared at once with so many of those behind them.
BLOCK, WIDE_BLOCK = 64, 1 << 15


def fingerprint(text: bytes, width: int = 3, seed: int = SEED) -> int:
    """A-Z lower-cased, white-space words, `width`-word shingles with repeats; bit set if set in over half the hashes."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) < width:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    one = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    end = (start + size)[width - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(one[a:b], seed) for a, b in zip(start[: len(end)].tolist(), end.tolist())), np.uint64, len(end))
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    raw = h.view(np.uint8).reshape(-1, 8)
    for a in range(0, len(raw), 65535):
        bits = np.unpackbits(raw[a : a + 65535], axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Every row's doc_id with fp, its fingerprint as a signed long.  Null or wordless text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fp = [_signed(fingerprint(x.as_py() or b"", width)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class Forest:
    """A spanning forest of the links among n nodes, as they come."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.up[a] != self.up[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))
        while (self.up != (flat := self.up[self.up])).any():  # every node hangs on its root, so the next links are sifted at once
            self.up = flat


def link_list(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct fingerprints of one list."""
    n = len(fps)
    raw = fps.view(np.uint8).reshape(-1, BYTES)
    forest = Forest(n)
    for i in range(0, n - 1, BLOCK):
        for j in range(i + 1, n, WIDE_BLOCK):
            tally = (raw[i : i + BLOCK, None] == raw[None, j : j + WIDE_BLOCK]).sum(2, dtype=np.int8)
            a, b = np.nonzero(tally >= BYTES - MAX_BITS)
            a, b = a + i, b + j
            ok = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]) <= MAX_BITS)
            forest.add(a[ok], b[ok])
    return forest.links


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (set, key): the rows of a list come together, in one batch or several."""
    held: list[np.ndarray] = []
    mark = None

    def emit() -> pa.RecordBatch | None:
        fps = np.unique(np.concatenate(held))
        if len(fps) < 2:
            return None
        forest = link_list(fps)
        if not forest:
            return None
        signed = fps.view(np.int64)
        a, b = np.array(forest).T
        return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["a", "b"])

    for batch in batches:
        kind, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(fp):
            continue
        cut = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
        edges = [0, *cut.tolist(), len(fp)]
        a_out, b_out = [], []
        for a, b in zip(edges, edges[1:]):
            now = (int(kind[a]), int(key[a]))
            if now != mark:
                if mark is not None and sum(map(len, held)) > 1 and (x := emit()) is not None:
                    a_out.append(x.column(0))
                    b_out.append(x.column(1))
                held, mark = [], now
            held.append(fp[a:b].astype(np.int64).view(np.uint64))
        if a_out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(a_out), pa.concat_arrays(b_out)], names=["a", "b"])
    if mark is not None and sum(map(len, held)) > 1 and (x := emit()) is not None:
        yield x


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span every group linked at MAX_BITS bits or fewer."""
    keys = []
    for i, positions in enumerate(SETS):
        mask = _signed(sum(0xFF << (8 * p) for p in positions))
        keys.append(F.struct(F.lit(i).cast("tinyint").alias("set"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")))
    posted = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.set", "k.key", "fp")
    dealt = posted.repartition(partitions(distinct.sparkSession), "set", "key").sortWithinPartitions("set", "key")
    return dealt.mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of distinct fingerprints) of every row.

    Equal fingerprints always share a component.  Null, empty and wordless texts have fingerprint zero and are linked
    like any other; a very long text is hashed whole in its task.  Columns other than doc_id and text are not read.  Repeated rows give repeated rows; rows of null doc_id take part, and a component of only such
    rows has a null id.  An empty table gives no rows.
    """
    fp = checkpoint(fingerprints(docs, width))
    groups = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(groups.select("fp"))).withColumnRenamed("a", "fp")
    named = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return fp.join(whole, "fp").select("doc_id", "fp", "component_id")


WIDTH, SIMILARITY = 5, 0.8

# Similar shingle sets, exactly.

#: Documents of the sample that tells frequent shingles, how often a shingle must stand in it, and how many are kept.
SAMPLE, OFTEN, FREQUENT = 16384, 4, 1 << 16
#: Pairs of a task that are gathered before they are handed on, and bytes of a sketch.
PAIRS, SKETCH = 1 << 20, 128
#: Bits of the filter that names the texts of candidate pairs; more of them than this make it weaker, never wrong.
FILTER = 1 << 22


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles as sorted hashes; fewer words than `width` are one shingle."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    one = b" ".join(w)
    k = min(width, len(w))
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    end = (start + size)[k - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(one[a:b], SEED) for a, b in zip(start[: len(end)].tolist(), end.tolist())), np.uint64, len(end)))


def prefix(h: np.ndarray, often: np.ndarray, rank: np.ndarray, share: Fraction) -> np.ndarray:
    """The first shingles of a set in the order of all (rare ones by hash, then the frequent ones by rank).

    Two sets at a similarity of `share` or more have at least share x size shingles in common, so one of them is in both prefixes.
    """
    n = len(h)
    at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
    place = np.where(often[at] == h, rank[at], 0) if len(often) else np.zeros(n, np.int64)
    return h[np.lexsort((h, place))][: n + share.numerator * -n // share.denominator + 1]


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank from 1, most frequent last) of the shingles that many documents of a sample hold.

    They come last in prefixes, which keeps lists short.  Any order gives the same pairs, so the sample cannot lose one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).cast(pa.large_binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(x.as_py() or b"", width).view(np.int64))], names=["h"])

    texts = docs.select("text", F.xxhash64("text").alias("tid"))
    step = max(1, docs.count() // SAMPLE)
    some = texts.where(F.pmod("tid", F.lit(step)) == 0).dropDuplicates(["tid"]).select("text")
    found = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    rows = found.orderBy(F.col("count").desc(), "h").limit(FREQUENT).select("h").toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(rows) - np.arange(len(rows), dtype=np.int64))[order]


def _set_rows(docs: DataFrame, width: int, share: Fraction) -> DataFrame:
    """doc_id, tid (names the text), node (names the shingle set), n (its size), fp (its fingerprint), its prefix and its sketch (how many hashes have each remainder by SKETCH, 255 at most) of every row."""
    often = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, fp, first, sketch = [], [], [], [], []
            for x in batch.column(2).cast(pa.large_binary()):
                h = shingle_hashes(x.as_py() or b"", width)
                node.append(_signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)))
                n.append(len(h))
                fp.append(_signed(_majority(h)) if len(h) else 0)
                first.append(prefix(h, *often.value, share).tobytes() if len(h) else b"")
                sketch.append(np.minimum(np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(first, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "tid", "node", "n", "fp", "first", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(run, f"doc_id {kind}, tid long, node long, n long, fp long, first binary, sketch binary")


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes to list entries: shingle, size and name of the set, place of the shingle in the set's order."""
    for batch in batches:
        tid, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        first = batch.column(2).to_pylist()
        ends = np.cumsum([len(x) // 8 for x in first])
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            size = np.array([len(x) // 8 for x in first[a:b]])
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            h = np.frombuffer(b"".join(first[a:b]), np.int64)
            columns = (h, np.repeat(n[a:b], size).astype(np.int32), np.repeat(tid[a:b], size), place.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "n", "tid", "place"])
            a = b


def _allowed(n1, place1, n2, place2, share: Fraction):
    """Whether what is left of two sets from a shared shingle on allows the similarity: a pair at the similarity passes at the first shingle that it shares."""
    p, q = share.numerator, share.denominator
    return np.minimum(n1 - place1, n2 - place2) * (p + q) >= (n1 + n2) * p


#: Ranks of list entries, each held by a 16th of the one below.
RANKS = 5


def _rank(tid: np.ndarray) -> np.ndarray:
    """How many of the last hexadecimal digits of a hash are zero, RANKS - 1 at most."""
    low = mix(tid.view(np.uint64))
    return sum(((low & np.uint64(16**k - 1)) == 0).astype(np.int64) for k in range(1, RANKS))


def _elders(h: np.ndarray, tid: np.ndarray) -> np.ndarray:
    """For each entry the last one before it, in its list, of a higher rank, or else of its own or a higher; -1 if there is none."""
    rank, at = _rank(tid), np.arange(len(tid))
    out = np.full(len(tid), -1)
    for k in range(RANKS):
        for least in (k, k + 1):
            last = np.concatenate([[-1], np.maximum.accumulate(np.where(rank >= least, at, -1))])[:-1]
            out = np.where((rank == k) & (last >= 0) & (h[last] == h), last, out)
    return out


def _chained(share: Fraction):
    """List entries sorted by (h, n, tid), in batches, to rows (a, b, h, n, place).

    Without h: candidate pairs, at most two for each entry: with the one before it and with its elder, so that a long list of copies
    hangs together by few steps.  With h: the entries (a is the tid) of three or more in a row whose sizes allow the similarity, which may make further pairs.
    A few entries are held between batches, however long a list is.
    """
    p, q = share.numerator, share.denominator

    def pairs(entries: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        h, n, tid, place = entries
        ok = (j >= 0) & (n[j] * q >= n[i] * p) & _allowed(n[j], place[j], n[i], place[i], share)
        a, b = tid[j[ok]], tid[i[ok]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64)] * 4
        held, elders = none, none
        joined = third = np.zeros(0, bool)  # of the entries held: whether they join the one before, and that one another

        def rows(end: bool, now: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal held, joined, third, elders
            old = len(held[0])
            entries = [np.concatenate([a, b]) for a, b in zip(held, now)]
            h, n, tid, place = entries
            link = np.zeros(len(h), bool)
            link[1:] = (h[1:] == h[:-1]) & (n[:-1] * q >= n[1:] * p)
            link[:old] = joined
            two = link.copy()
            two[1:] &= link[:-1]
            two[:old] = third
            new = np.arange(len(h)) >= old
            i = np.flatnonzero(link & new)
            found = pairs(entries, i, i - 1)
            known = [np.concatenate([a, b]) for a, b in zip(elders, now)]
            at = _elders(known[0], known[2])
            i = np.arange(len(elders[0]), len(at))
            found = np.unique(np.concatenate([found, pairs(known, i, at[i])], axis=1), axis=1)
            rank = _rank(known[2])
            last = known[0] == known[0][-1] if len(rank) else np.zeros(0, bool)
            keep = sorted({int(x[-1]) for k in range(RANKS) if len(x := np.flatnonzero(last & (rank >= k)))})
            elders = [x[keep] for x in known]
            more = np.append(link[1:], False)
            many = two | (link & more) | (more & np.append(more[1:], False))
            cut = len(h) if end else max(0, len(h) - 2)
            e = np.flatnonzero(many[:cut])
            held, joined, third = [x[cut:] for x in entries], link[cut:], two[cut:]
            m = found.shape[1]
            a = np.concatenate([found[0], tid[e]])
            b = pa.concat_arrays([pa.array(found[1]), pa.nulls(len(e), pa.int64())])
            rest = [pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(x[e])]) for x in (h, n, place)]
            return pa.RecordBatch.from_arrays([pa.array(a), b, *rest], names=["a", "b", "h", "n", "place"])

        for batch in batches:
            if len(batch):
                yield rows(False, [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        yield rows(True, none)

    return run


def list_pairs(n: np.ndarray, tid: np.ndarray, place: np.ndarray, label: np.ndarray, share: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (lesser name, greater name) of different labels among one list's entries, sorted by n.

    Every entry without the list's most common label is compared with those whose sizes allow the similarity.
    """
    p, q = share.numerator, share.denominator
    names, which, count = np.unique(label, return_inverse=True, return_counts=True)
    most = which == count.argmax()
    low, high = np.searchsorted(n * q, n * p, "left"), np.searchsorted(n * p, n * q, "right")
    out, held = [], 0
    for i in np.flatnonzero(~most):
        j = np.arange(low[i], high[i])
        j = j[(which[j] != which[i]) & (most[j] | (j > i)) & _allowed(n[i], place[i], n[j], place[j], share)]
        out.append(np.stack([np.minimum(tid[i], tid[j]), np.maximum(tid[i], tid[j])]))
        held += len(j)
        if held > PAIRS:
            yield tuple(np.unique(np.concatenate(out, axis=1), axis=1))
            out, held = [], 0
    if held:
        yield tuple(np.unique(np.concatenate(out, axis=1), axis=1))


def _crossed(share: Fraction):
    """Batches of (h, n, tid, place, label) sorted by (h, n) to candidate pairs; a list may go on in the next batch."""

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = columns[0]
        edges = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
        for x, y in zip(edges, edges[1:]):
            for a, b in list_pairs(*[c[x:y] for c in columns[1:]], share):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            if not len(batch):
                continue
            now = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, r in enumerate(rest)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last list may not be whole yet
            rest = [x[last:] for x in now]
            if last:
                yield from pairs([x[:last] for x in now])
        if len(rest[0]):
            yield from pairs(rest)

    return run


def _possible(share: Fraction):
    """Pairs whose sketches allow the similarity, with what stands behind the sketches: the sets differ in as many shingles as the sketches, or more."""
    p, q = share.numerator, share.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for i in (4, 5))
            near = np.abs(one - two).sum(1, dtype=np.int64) * (p + q) <= n * (q - p)
            yield batch.select([0, 1, *range(6, batch.num_columns)]).filter(pa.array(near))

    return run


def _sets(bits, width: int):
    """Texts that the filter names to their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = bits.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False) & (FILTER - 1)
            batch = batch.filter(pa.array((named[at >> 5] >> (at & 31)) & 1 == 1))
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                h = [shingle_hashes(x.as_py() or b"", width) for x in part.column(1).cast(pa.large_binary())]
                off = np.concatenate([[0], np.cumsum([len(x) for x in h])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(h).view(np.int64)))], names=["tid", "h"])

    return run


def _likely(groups: DataFrame, pairs: DataFrame, share: Fraction) -> DataFrame:
    """Those of pairs(a, b, ...) whose sketches allow the similarity; none that has it is lost."""
    more = [f"{k} {t}" for k, t in pairs.dtypes if k not in "ab"]
    names = [x.split()[0] for x in more]
    for c in "ab":
        pairs = pairs.join(groups.select(F.col("tid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    return pairs.select("a", "b", "na", "nb", "sa", "sb", *names).mapInArrow(_possible(share), ", ".join(["a long", "b long", *more]))


def _verified(docs: DataFrame, pairs: DataFrame, width: int, share: Fraction) -> DataFrame:
    """Those of pairs(a, b) of sets whose Jaccard similarity is `share` or more, by the whole sets."""
    spark = docs.sparkSession
    # a fixed number of bits names the texts of the pairs, so that no text is shuffled
    needed = pairs.select(F.explode(F.array("a", "b")).alias("tid"))
    at = needed.select(F.col("tid").bitwiseAND(F.lit(FILTER - 1)).alias("at"))
    word = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
    named = np.zeros(FILTER >> 5, np.int64)
    words = word.toArrow()
    named[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    bits = spark.sparkContext.broadcast(named)
    texts = docs.select(F.xxhash64("text").alias("tid"), "text")
    sets = checkpoint(texts.mapInArrow(_sets(bits, width), "tid long, h array<long>").dropDuplicates(["tid"]))
    bits.unpersist()
    give_back()
    one, two = (sets.select(F.col("tid").alias(c), F.col("h").alias(f"h{c}")) for c in "ab")
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    total = F.size("ha") + F.size("hb") - both
    return pairs.join(one, "a").join(two, "b").where(both * share.denominator >= total * share.numerator).select("a", "b")


def _near(groups: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of sets by the index of positional bytes: each set with the least of its fingerprint, and these as `links` joins them."""
    sets = groups.where("n > 0").select("fp", "tid")
    least = checkpoint(sets.groupBy("fp").agg(F.min("tid").alias("least")))
    # the fingerprint is rewritten (to itself), so that Spark can split a hot one of these joins
    dealt = least.select(F.col("fp").bitwiseXOR(F.lit(0)).alias("fp"), "least")
    same = sets.join(dealt, "fp").select(F.col("least").alias("a"), F.col("tid").alias("b"))
    near = links(least.select("fp"))
    for c in "ab":
        near = near.join(dealt.select(F.col("fp").alias(c), F.col("least").alias(f"t{c}")), c)
    pairs = same.unionByName(near.select(F.col("ta").alias("a"), F.col("tb").alias("b"))).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _first(likely: DataFrame) -> DataFrame:
    """The pairs (a, b) of likely(a, b, lists, near) that are verified first: the near ones, and for each set the one that it shares most lists with and those of least hash by two seeds.

    Nearly every link is among these few, and what a set's other pairs would add is known once they have been followed.
    """
    ends = likely.select(F.col("a").alias("x"), F.col("b").alias("y"), "lists").unionByName(likely.select(F.col("b").alias("x"), F.col("a").alias("y"), "lists"))
    hashed = ends.select("x", "y", "lists", F.xxhash64("y").alias("h"), F.xxhash64("y", F.lit(1)).alias("h1"))
    best = hashed.groupBy("x").agg(F.max(F.struct("lists", "h", "y")).alias("most"), F.min(F.struct("h", "y")).alias("least"), F.min(F.struct("h1", "y")).alias("least1"))
    own = best.select("x", F.explode(F.array("most.y", "least.y", "least1.y")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return own.unionByName(likely.where("near").select("a", "b")).distinct()


def similar_roots(docs: DataFrame, groups: DataFrame, width: int, share: Fraction, folder: str) -> DataFrame:
    """(tid, root): the components of the sets of groups(tid, n, fp, first, sketch), named by one text of each, linked at a Jaccard similarity of `share` or more.

    Candidates are the pairs within MAX_BITS bits, from the index of positional bytes.  Three bits cannot tell every pair at the similarity, so lists of shingles
    give the rest: each entry of a list is paired with the one before it and with an elder, at most two pairs for each entry.  A few pairs of each set are verified first (see _first).  That joins the copies of a text, whose
    lists are long, to one component.  Then come the other candidates that still join two components, and with them all pairs across components of the lists of three entries or more that hold several.
    """
    spark = docs.sparkSession
    posted = groups.where("n > 0").select("tid", "n", "first").mapInArrow(_posted, "h long, n int, tid long, place int")
    dealt = posted.repartition(partitions(spark), "h").sortWithinPartitions("h", "n", "tid")
    listed = _written(dealt.mapInArrow(_chained(share), "a long, b long, h long, n long, place long"), f"{folder}/listed")
    near = _near(groups).withColumn("near", F.lit(True)).unionByName(listed.where("h is null").select("a", "b", F.lit(False).alias("near")))
    pairs = checkpoint(near.groupBy("a", "b").agg(F.count("*").alias("lists"), F.max("near").alias("near")))
    likely = checkpoint(_likely(groups, pairs, share))
    few = checkpoint(_first(likely))
    first = checkpoint(components(_verified(docs, few, width, share)).withColumnRenamed("a", "tid"))
    give_back()
    entries = listed.where("h is not null").select("h", "n", F.col("a").alias("tid"), "place").join(first, "tid", "left").withColumn("label", F.coalesce("root", "tid")).drop("root")
    # the shingle is rewritten (to itself), so that Spark can split a hot one of this join
    mixed = entries.groupBy("h").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select(F.col("h").bitwiseXOR(F.lit(0)).alias("h"))
    entries = entries.join(mixed, "h", "left_semi").select("h", "n", "tid", "place", "label")
    pairs = checkpoint(entries.repartition(partitions(spark), "h").sortWithinPartitions("h", "n", "tid").mapInArrow(_crossed(share), "a long, b long").distinct())
    delete_folder(spark, f"{folder}/listed")
    rest = likely.join(few, ["a", "b"], "left_anti").select("a", "b")
    for c in "ab":
        rest = rest.join(first.select(F.col("tid").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    rest = rest.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    pairs = checkpoint(_likely(groups, pairs, share).unionByName(rest).distinct())
    links = _verified(docs, pairs, width, share)
    for c in "ab":
        links = links.join(first.select(F.col("tid").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    second = components(links).select(F.col("a").alias("root"), F.col("root").alias("_top"))
    # what the second round joins: roots of the first, and sets that had no link before
    known = groups.select("tid").join(first, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    return known.join(second, "root", "left").select("tid", F.coalesce("_top", "root").alias("root"))


def _written(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet, for what is deleted before the query ends: a checkpoint stays until the driver happens to collect its garbage, and takes several times the place."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each query's shuffle files go as it ends: all of them end in the shared folder, and nothing reads their shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _named(docs: DataFrame, width: int, similarity: float, rows_too: bool) -> tuple[DataFrame | None, DataFrame]:
    """(doc_id, node) of every row, if asked for, and (node, root, least): each set's component and the smallest doc_id of its texts."""
    give_back()
    spark = docs.sparkSession
    share = Fraction(similarity).limit_denominator(10**6)
    folder = f"{shared_folder(spark)}/similar-{uuid.uuid4().hex}"
    try:
        with _shuffles_freed(spark):
            rows = _written(_set_rows(docs, width, share), f"{folder}/rows")
            groups = _written(rows.groupBy("node", "n", "fp", "first", "sketch").agg(F.min("doc_id").alias("least"), F.min("tid").alias("tid")), f"{folder}/groups")
            nodes = checkpoint(rows.select("doc_id", "node")) if rows_too else None
            delete_folder(spark, f"{folder}/rows")
            roots = similar_roots(docs, groups, width, share, folder)
            return nodes, checkpoint(groups.select("node", "tid", "least").join(roots, "tid").select("node", "root", "least"))
    finally:
        delete_folder(spark, folder)


def similar_documents(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id of every row: groups linked at this Jaccard similarity (above 0) of their shingle sets, or more.

    Candidates are the sets whose fingerprints the index of positional bytes links, and an exact way gives the rest.  Every pair at the similarity is found: such sets share a shingle of their prefixes (see prefix), which are the keys of
    lists; every pair of a list that may join two components is verified on the whole sets, unless its sketches rule it out.  Equal sets are one node, named by one of their texts.
    Null and wordless texts are one group; a very long text is one set; null doc_ids and repeated rows are as in near_duplicates.
    """
    nodes, named = _named(docs, width, similarity, True)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = named.select("node", "root").join(ids, "root").select("node", "component_id")
    return nodes.join(whole, "node").select("doc_id", "component_id")


def similar_firsts(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """component_id of every group of similar_documents, once."""
    return _named(docs, width, similarity, False)[1].groupBy("root").agg(F.min("least").alias("component_id")).select("component_id")


def hex_digits(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def first_of_groups(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of docs for each group that find(docs) names by its component_id, once or for each row: that of the smallest doc_id, null the greatest, and then of the least hash of the text.

    Rows are told apart by doc_id and text, so texts of equal or null doc_id that nothing links all stay; of rows that agree in
    both, the first by its other columns stays.
    """
    tid = F.xxhash64("text")
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", tid.alias("tid")).alias("doc_id"), "text")
    kept = find(named).select(F.col("component_id.doc_id").alias("_of"), F.col("component_id.tid").alias("_tid")).distinct()
    one = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_of"]) & (F.xxhash64(docs["text"]) == kept["_tid"]), "left_semi")
    order = Window.partitionBy("doc_id", tid).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0))
    place = new_name("place", docs)
    return one.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)


def drop_near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row of each group that near_duplicates links (see first_of_groups)."""
    return first_of_groups(docs, lambda named: near_duplicates(named, width))


def drop_similar(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group that similar_documents links (see first_of_groups)."""
    return first_of_groups(docs, lambda named: similar_firsts(named, width, similarity))
