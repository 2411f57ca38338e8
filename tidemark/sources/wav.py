"""A data source of PCM and float WAV files in blocks of samples: spark.read.format("wav").load(path).

Partitions are byte ranges, so a file of any length is read by many tasks, each holding one block at a time; small files share a
partition.  A block belongs to the range that its first byte is in.  A halo can be read with every block, so that framing and
windows over blocks need no exchange.

Options: blockSamples (65,536), before and after (halo samples, 0), partitionBytes (32 MB).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: own is the number of samples of the block itself; `samples` also holds `lead` samples before them, and as many behind as the halo reaches.
SCHEMA = "clip string, path string, sr double, block long, start long, own long, lead long, samples array<double>, error string"
BLOCK_SAMPLES, PARTITION_BYTES = 1 << 16, 32 << 20
#: What a file costs besides its bytes when files are put together in a partition.
OPEN_BYTES = 1 << 20
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def samples(data: bytes, width: int, channels: int, float_: bool = False) -> np.ndarray:
    """Little-endian samples of 1 (unsigned), 2, 3 or 4 bytes as numbers in [-1, 1), or floats of 4 or 8 bytes; channels are averaged."""
    if float_:
        x = np.frombuffer(data, {4: "<f4", 8: "<f8"}[width]).astype(float)
    elif width == 1:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1)


class Layout:
    """Where a file's samples are, from its chunk headers alone."""

    def __init__(self, file, size: int) -> None:
        head = file.read(12)
        if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
            raise ValueError("not a WAV file")
        self.width = 0
        while True:
            head = file.read(8)
            if len(head) < 8:
                raise ValueError("no data chunk")
            name, length = head[:4], struct.unpack("<I", head[4:])[0]
            at = file.tell()
            if name == b"fmt ":
                kind, self.channels, rate, _, _, bits = struct.unpack("<HHIIHH", (fmt := file.read(min(length, 40)))[:16])
                if kind == EXTENSIBLE and len(fmt) >= 26:
                    kind = struct.unpack("<H", fmt[24:26])[0]
                self.rate, self.width, self.float = float(rate), (bits + 7) // 8, kind == FLOAT
                if kind not in (PCM, FLOAT) or self.width not in ((4, 8) if self.float else (1, 2, 3, 4)) or not self.channels:
                    raise ValueError(f"format {kind} of {bits} bits")
            elif name == b"data":
                if not self.width:
                    raise ValueError("no format chunk")
                self.offset, self.frame = at, self.width * self.channels
                # a stream's writer may not have known the length
                self.n = (size - at if length in (0, 0xFFFFFFFF) else min(length, size - at)) // self.frame
                return
            file.seek(at + length + length % 2)


class Ranges(InputPartition):
    def __init__(self, parts: list[tuple[str, int, int, int]]) -> None:
        self.parts = parts  # (path, size of the file, first byte, end byte)


class WavReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.block = int(options.get("blocksamples", BLOCK_SAMPLES))
        self.before, self.after = int(options.get("before", 0)), int(options.get("after", 0))
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def _files(self):
        import os

        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))

    def partitions(self) -> list[Ranges]:
        from pyarrow.fs import FileSelector, FileType

        files, base = self._files()
        info = files.get_file_info(base)
        found = [info] if info.type == FileType.File else files.get_file_info(FileSelector(base, recursive=True))
        out: list[Ranges] = []
        parts, filled = [], 0
        for x in sorted((f for f in found if f.type == FileType.File and f.path.lower().endswith(".wav")), key=lambda f: f.path):
            for a in range(0, max(x.size, 1), self.bytes):
                b = min(a + self.bytes, x.size)
                if parts and filled + b - a > self.bytes:
                    out.append(Ranges(parts))
                    parts, filled = [], 0
                parts.append((x.path, x.size, a, b))
                filled += b - a + OPEN_BYTES
        return [*out, *([Ranges(parts)] if parts else [])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = self._files()
        for path, size, a, b in partition.parts:
            clip = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            with files.open_input_file(path) as file:
                try:
                    at = Layout(file, size)
                except (ValueError, struct.error) as e:
                    if a == 0:
                        yield self._row(clip, path, None, None, None, None, None, None, str(e))
                    continue
                step = self.block * at.frame
                first = 0 if a == 0 else max(0, -(-(a - at.offset) // step))
                end = max(0, -(-(b - at.offset) // step))
                if a == 0 and (at.n == 0 or end == 0):
                    end = 1  # a clip without samples is one empty block, and the first range has the first block at least
                elif a and first == 0:
                    first = 1
                for k in range(first, min(end, max(1, -(-at.n // self.block)))):
                    start = k * self.block
                    low, high = max(0, start - self.before), min(at.n, start + self.block + self.after)
                    file.seek(at.offset + low * at.frame)
                    x = samples(file.read((high - low) * at.frame), at.width, at.channels, at.float)
                    yield self._row(clip, path, at.rate, k, start, min(self.block, at.n - start), start - low, x, None)

    @staticmethod
    def _row(clip, path, rate, block, start, own, lead, x, error) -> pa.RecordBatch:
        values = pa.array([None], pa.list_(pa.float64())) if x is None else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        numbers = [pa.array([v], pa.int64()) for v in (block, start, own, lead)]
        arrays = [pa.array([clip]), pa.array([path]), pa.array([rate], pa.float64()), *numbers, values, pa.array([error], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["clip", "path", "sr", "block", "start", "own", "lead", "samples", "error"])


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_blocks(spark: SparkSession, path: str, block_samples: int = BLOCK_SAMPLES, before: int = 0, after: int = 0, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The blocks of every .wav file at or below a path (see SCHEMA).  A file that doesn't decode is one row with an error; one without samples is one empty block.

    The path must be one that the executors' pyarrow can open: a shared folder, hdfs, s3 or gs.  For stores that only Spark reads there is `readers.read_wav`.
    """
    spark.dataSource.register(WavSource)
    options = {"blockSamples": block_samples, "before": before, "after": after, "partitionBytes": partition_bytes}
    return spark.read.format("wav").options(**options).load(path)
