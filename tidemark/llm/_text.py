"""Vectorised word handling on Arrow string columns, and the shared checkpoint helper.

Words are found on UTF-8 bytes: every separator class used here is ASCII, and an ASCII byte never
occurs inside a multi-byte character, so bytes and code points give the same words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.shared import checkpoint, delete_folder, shared_folder  # noqa: F401  (the operators take them from here)

#: Bytes of text that one vectorised step works on.  A longer single text is still taken whole.
SLICE_BYTES = 4 << 20

WHITE = [0x20, *range(0x09, 0x0E)]
#: True for bytes of words `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, bool)
NON_SPACE[WHITE] = False
#: True for bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Maps A-Z to a-z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def give_back() -> None:
    """Gives the driver's freed arrays back to the system: those of a fitted model would stay with the C library and Arrow's pool until asked for.

    The JVM is left alone: collecting it between rounds made its heap grow sooner.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def new_name(name: str, *frames: DataFrame) -> str:
    """`name` with as many underscores in front as make it a column of none of the frames, whatever the case of its letters."""
    used = {c.lower() for df in frames for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; null is empty."""
    arr = batch.column(column).cast(pa.large_binary())
    n = len(arr)
    if not n:
        return
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of each word, and for each text the index of its first word, with the total at the end."""
    inside = table[data]
    docs = off[:-1][off[:-1] < off[1:]]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[docs] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[docs[docs > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, off)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            up[0] = 1
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 24:
            _powers.clear()
            _powers[size] = up, down
        return up, down
    return _powers[size]


def forget_powers() -> None:
    """Frees the powers that span_hash keeps from call to call, for processes that do not go on hashing."""
    _powers.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for every pair, in time linear in the values."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(values))
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, off: np.ndarray, table: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word with the total at the end)."""
    start, end, first = words(data, off, table)
    return span_hash(LOWER[data] if lower else data, start, end), first


def plain(batch: pa.RecordBatch, skip: set[str] = frozenset()) -> list[str]:
    return [n for n in batch.schema.names if n not in skip]
