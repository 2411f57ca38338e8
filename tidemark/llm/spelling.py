"""Spelling variants by finite-state composition.

The pairs of vocabulary words that differ by one inserted, deleted or replaced code point are the paths of a composition: the
minimised acceptor of the vocabulary, a transducer of exactly one edit, and the acceptor again.  The composition is enumerated
in partitions by its initial state.  A pair (u, v) with len(u) = L and len(v) = L or L + 1 has its edit at the length of its
common prefix, a place in [0, L].  Places [lo, hi) make one partition for each head of lo code points and tail of L - hi code
points: there both words pass the same states outside the places, and only the acceptors of their middles are composed.  All
places are halved once, so that every word is in four partitions; one that still holds more than `group` words is halved again,
down to single places, where an alphabet bounds it.  So no prefix or ending, however frequent, outgrows a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._text import checkpoint, partitions

#: Words have at least so many code points and occurrences; a form has so many times the occurrences of its word.
LENGTH, TIMES, RATIO = 6, 5, 5
#: One in so many distinct runs of a document loses a code point.
SLIPS = 199
#: Words of a partition of the composition, unless its places can't be halved any more.
GROUP = 2048
#: Distinct words that a task adds up before it sends them on.
HELD = 1 << 17


def word_counts(docs: DataFrame, length: int = LENGTH, times: int = TIMES, slips: int = SLIPS) -> DataFrame:
    """(word, n): runs of `[A-Za-z\\u00C0-\\u00FF]` with A-Z lower-cased, of `length` code points and `times` occurrences at least.

    If `slips` divides the unsigned CRC-32 h of `<doc_id>:<run>`, the run's code point h % len(run) is left out.  Texts are taken
    whole; a null text has no word, a null doc_id is written as nothing, repeated rows count each, other columns are not read.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{length},}}")  # runs are maximal: shorter rests of one never match

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(pattern.findall(text.encode().lower().decode())).items():  # bytes.lower() changes A-Z only
                    h = zlib.crc32(word.encode(), seed)
                    if h % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield rows()
        if total:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class Acceptor:
    """The minimal deterministic acceptor of words given in ascending order, without repeats."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self._known: dict[tuple, int] = {}
        path, last = [0], ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._settle(path, last, same)
            for c in word[same:]:
                self.arcs[path[-1]][c] = len(self.arcs)
                path.append(len(self.arcs))
                self.arcs.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            last = word
        self._settle(path, last, 0)

    def _settle(self, path: list[int], word: str, depth: int) -> None:
        """States of the path beyond depth get no more arcs: each gives way to an equal one, if there is one."""
        while len(path) - 1 > depth:
            state = path.pop()
            same = self._known.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
            self.arcs[path[-1]][word[len(path) - 1]] = same


class Composition:
    """left, one edit, right: enumerates the pairs of words of the two acceptors that the edit turns into one another."""

    def __init__(self, left: Acceptor, right: Acceptor) -> None:
        self.left, self.right = left, right
        self._rests: dict[tuple[int, int], list[str]] = {}

    def rests(self, p: int, q: int) -> list[str]:
        """What both sides accept from these states on: the paths after the edit, from where nothing but matches follow."""
        key = (p, q)
        if key not in self._rests:
            out = [""] if self.left.final[p] and self.right.final[q] else []
            arcs = self.right.arcs[q]
            for c, to in self.left.arcs[p].items():
                if c in arcs:
                    out += [c + rest for rest in self.rests(to, arcs[c])]
            self._rests[key] = out
        return self._rests[key]

    def _paths(self, edits) -> Iterator[tuple[str, str]]:
        """Matches from the initial state on, then the edits of a state, which are found once for all prefixes that lead to it."""
        found: dict[tuple[int, int], list[tuple[str, str]]] = {}
        stack = [(0, 0, "")]
        while stack:
            p, q, prefix = stack.pop()
            if (p, q) not in found:
                found[p, q] = edits(p, q)
            for x, y in found[p, q]:
                yield prefix + x, prefix + y
            arcs = self.right.arcs[q]
            stack += [(to, arcs[c], prefix + c) for c, to in self.left.arcs[p].items() if c in arcs]

    def replaced(self) -> Iterator[tuple[str, str]]:
        """Pairs that differ in one code point, each once; both acceptors are the same."""

        def edits(p: int, q: int) -> list[tuple[str, str]]:
            arcs = list(self.left.arcs[p].items())
            return [(c + rest, d + rest) for k, (c, to) in enumerate(arcs) for d, other in arcs[:k] for rest in self.rests(to, other)]

        return self._paths(edits)

    def inserted(self, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs whose right word has one code point more, each once: inserted as late as can be, and at the end only if so asked."""

        def edits(p: int, q: int) -> list[tuple[str, str]]:
            return [(rest, d + rest) for d, to in self.right.arcs[q].items() for rest in self.rests(p, to) if (rest[0] != d if rest else at_end)]

        return self._paths(edits)


def _places(words: DataFrame, group: int) -> DataFrame:
    """(length, lo, hi, key, word, n): every word in the partitions of its own length and of one less."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length"))
    rows = rows.select("*", F.lit(0).alias("lo"), (F.col("length") + 1).alias("hi"))

    def halved(rows: DataFrame) -> DataFrame:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        half = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))).alias("half")
        rows = rows.select("word", "n", "length", half).select("word", "n", "length", "half.lo", "half.hi")
        tail = F.greatest(F.lit(0), F.col("length") - F.col("hi"))
        head, tail = F.col("word").substr(F.lit(1), F.col("lo")), F.col("word").substr(F.char_length("word") - tail + 1, tail)
        return rows.withColumn("key", F.concat_ws(":", "length", "lo", "hi", head, tail))

    rows = halved(rows)
    while True:
        full = checkpoint(rows.where(F.col("hi") - F.col("lo") > 1).groupBy("key").count().where(F.col("count") > group).select("key"))
        if full.isEmpty():
            return rows
        rows = checkpoint(rows.join(full, "key", "left_anti").unionByName(halved(rows.join(full, "key", "left_semi").drop("key"))))


def _near(length: int, lo: int, hi: int, words: list[tuple[str, int]]) -> dict[str, list]:
    """Of each word of a partition that has near words in it: their number, and the largest n with the smallest such word."""
    tail = max(0, length - hi)
    sides: tuple[dict, dict] = {}, {}
    for word, n in words:
        sides[len(word) - length][word[lo : len(word) - tail]] = word, n
    equal, longer = sides
    left = Acceptor(sorted(equal))
    found: dict[str, list] = defaultdict(lambda: [0, 0, ""])

    def see(one: tuple[str, int], other: tuple[str, int]) -> None:
        for (word, _), (near, n) in ((one, other), (other, one)):
            best = found[word]
            best[0] += 1
            if n > best[1] or (n == best[1] and near < best[2]):
                best[1:] = n, near

    if len(equal) > 1:
        for x, y in Composition(left, left).replaced():
            see(equal[x], equal[y])
    if equal and longer:
        for x, y in Composition(left, Acceptor(sorted(longer))).inserted(at_end=hi > length):
            see(equal[x], longer[y])
    return found


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, near_n, near) of every word of words(word, n) that has a near word: their number, and the near word of largest
    n, the smallest in code-point order among equals.  Words must be distinct; no words give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for (_, length, lo, hi), part in groupby(rows, key=lambda r: r[:4]):
            part = [r[4:] for r in part]
            if len(part) > 1:
                out += [(word, *best) for word, best in _near(length, lo, hi, part).items()]
            if len(out) > 1 << 14:
                yield batch_of(out)
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near"])

    rows = _places(words, group).select("key", "length", "lo", "hi", "word", "n").repartition(partitions(words.sparkSession), "key").sortWithinPartitions("key")
    found = rows.mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form), which must be free of cycles: forms are followed to the last by doubling."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpoint(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(docs: DataFrame, length: int = LENGTH, times: int = TIMES, ratio: int = RATIO, slips: int = SLIPS, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents' vocabulary (see `word_counts`).

    form is the near word of largest n, ties to the smallest in code-point order, if that n is `ratio` times the word's own at
    least (ratio must be above 1, so that forms can't run in a circle); root is the last form of the chain, or the word itself.
    Null and empty texts add no words; an empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = checkpoint(word_counts(docs, length, times, slips))
    found = words.join(near_words(words, group), "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    found = checkpoint(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
