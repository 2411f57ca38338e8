"""Signals in blocks: a clip is many rows, so its length bounds no task.

A block is (clip, sr, block, start, own, lead, samples): samples holds the block's own samples from place `start` on, with `lead`
samples of a halo before them and as many behind as the halo reaches.  All blocks of a clip but the last have the same number of
own samples.  Operators over blocks equal the kernels over whole clips, wherever a clip is cut:

- windows that reach over an edge take a halo, read with the block or exchanged between neighbours;
- recursive filters carry their states by a prefix scan over blocks, whose steps are linear maps;
- prominences climb and descend a tree of the blocks' extremes.

Exchanges are keyed by (clip, block) or (clip, run of RUN blocks), never by clip alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import detect, kernels
from tidemark.params import Candidates, Stft

#: Blocks of a run, and levels of runs: a clip may have RUN ** LEVELS blocks.
RUN, LEVELS = 1024, 2
COLUMNS = ("clip", "sr", "block", "start", "own", "lead", "samples")


def as_blocks(series: DataFrame, sr: float, size: int) -> DataFrame:
    """Blocks of a series (clip, idx, value), idx from 0 without gaps."""
    rows = series.groupBy("clip", F.floor(F.col("idx") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value")))).alias("x"))
    return rows.select("clip", F.lit(float(sr)).alias("sr"), "block", (F.col("block") * size).alias("start"), F.size("x").cast("long").alias("own"), F.lit(0).cast("long").alias("lead"), F.transform("x", lambda r: r["value"]).alias("samples"))


def halo(blocks: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Blocks without a halo, given `before` samples of what lies before them and `after` behind: every block sends its neighbours what they lack."""
    back, ahead = -(-after // size), -(-before // size)  # a block sends to so many blocks before it and behind it
    last = F.col("start") + F.col("own")
    to = F.explode(F.sequence(F.greatest(F.col("block") - back, F.lit(0).cast("long")), F.col("block") + ahead))
    sent = blocks.select("clip", "sr", "block", "start", "own", "samples", to.alias("to"))
    begin, end = F.col("to") * size, (F.col("to") + 1) * size
    low, high = F.greatest("start", begin - before), F.least(last, end + after)
    piece = F.slice("samples", (low - F.col("start") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    own = F.col("to") == F.col("block")
    sent = sent.where(own | (high > low)).select("clip", F.col("to").alias("block"), F.struct(F.col("block").alias("of"), piece.alias("piece")).alias("p"), F.when(own, F.struct("sr", "start", "own")).alias("mine"))
    met = sent.groupBy("clip", "block").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.first("mine", ignorenulls=True).alias("mine")).where("mine is not null")
    lead = F.aggregate("ps", F.lit(0).cast("long"), lambda n, p: n + F.when(p["of"] < F.col("block"), F.size(p["piece"])).otherwise(0))
    return met.select("clip", "mine.sr", "block", "mine.start", "mine.own", lead.alias("lead"), F.flatten(F.transform("ps", lambda p: p["piece"])).alias("samples"))


def _kind(df: DataFrame, name: str = "clip") -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def each_block(blocks: DataFrame, kernel: Callable, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """clip and the columns of the schema that kernel(sr, block, start, own, lead, samples, *more) gives for each block: a tuple of arrays, or None."""
    columns = [*COLUMNS, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = None
        for rows in batches:
            clips, numbers = rows.column(0), [c.to_pylist() for c in rows.columns[1:6]]
            for i in range(len(rows)):
                x = rows.column(6)[i].values
                x = np.zeros(0) if x is None else x.to_numpy(zero_copy_only=False)
                out = kernel(*(c[i] for c in numbers), x, *(rows.column(k)[i].as_py() for k in range(7, len(columns))))
                if out is None or not len(out[0]):
                    continue
                arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in out]
                fields = fields or ["clip", *(c.split()[0] for c in schema.split(", "))]
                yield pa.RecordBatch.from_arrays([clips.take(pa.array(np.full(len(arrays[0]), i))), *arrays], names=fields)

    return blocks.select(*columns).mapInArrow(run, f"{_kind(blocks)}, {schema}")


def _rows(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def _own_frames(start: int, own: int, lead: int, n: int, n_fft: int, hop: int) -> tuple[int, int, int]:
    """(first frame that begins in the block, first one behind, last one that the samples hold, plus one); a short clip has one frame."""
    base = start - lead
    held = max(0, (base + n - n_fft) // hop + 1)
    if base == 0 and not held and n:
        held = 1
    return -(-start // hop), min(-(-(start + own) // hop), held), held


def _frames(x: np.ndarray, base: int, a: int, b: int, n_fft: int, hop: int) -> np.ndarray:
    part = x[a * hop - base : (b - 1) * hop - base + n_fft]
    return kernels.stft(part, n_fft, hop)[: b - a]


def stft_reach(p: Stft) -> tuple[int, int]:
    return 0, p.n_fft - 1


def stft_frames(blocks: DataFrame, p: Stft = Stft()) -> DataFrame:
    """(clip, idx, mag) of every frame, from blocks with a halo of at least `stft_reach`."""
    def kernel(sr, block, start, own, lead, x):
        a, b, _ = _own_frames(start, own, lead, len(x), p.n_fft, p.hop)
        return (np.arange(a, b), _rows(_frames(x, start - lead, a, b, p.n_fft, p.hop))) if b > a else None

    return each_block(blocks, kernel, "idx long, mag array<double>")


def feature_reach(sr: float, p: Stft = Stft(), c: Candidates = Candidates()) -> tuple[int, int]:
    """The halo that `frame_features` needs at a rate: the frames that the onset's average spans, and the envelope's and slope's windows."""
    smooth, env, k = max(1, int(sr * 0.01 / p.hop)), max(1, int(sr * c.envelope)), max(1, int(sr * c.attack))
    return max(p.hop * (smooth + 2), env + k + 1), max(p.n_fft + p.hop * (smooth + 1), p.hop + env + k)


def frame_features(blocks: DataFrame, p: Stft = Stft(), c: Candidates = Candidates()) -> DataFrame:
    """(clip, idx, onset, e_low, e_mid, e_high, flatness, attack) of every frame: the columns of the same names that
    `detect.frame_features` gives of whole clips, from blocks with a halo of at least `feature_reach`."""
    def kernel(sr, block, start, own, lead, x):
        base = start - lead
        a, b, held = _own_frames(start, own, lead, len(x), p.n_fft, p.hop)
        if b <= a:
            return None
        k = max(1, int(sr * 0.01 / p.hop))
        low, high = max(0, a - k - 1, -(-base // p.hop)), min(held, b + k + 1)
        m = _frames(x, base, low, high, p.n_fft, p.hop)
        freq = np.fft.rfftfreq(p.n_fft, 1 / sr)
        logs = np.log1p(m) * ((freq >= p.low_hz) & (freq <= p.high_hz))
        onset = np.concatenate([[0.0], np.maximum(np.diff(logs, axis=0), 0).sum(1)])
        at = slice(a - low, b - low)
        onset = kernels.moving_average(onset, k)[at]
        m = m[at]
        energy = [(m[:, (freq >= u) & (freq < v)] ** 2).sum(1) for u, v in p.bands]
        env = kernels.moving_average(np.abs(x), max(1, int(sr * c.envelope)))
        slope = detect.attack_curve(env, sr, c.attack)[a * p.hop - base : b * p.hop - base]
        slope = np.pad(slope, (0, (b - a) * p.hop - len(slope))).reshape(b - a, p.hop).max(1)
        return np.arange(a, b), onset, *energy, detect.flatness(m), slope

    return each_block(blocks, kernel, "idx long, onset double, e_low double, e_mid double, e_high double, flatness double, attack double")


def mel_patches(blocks: DataFrame, marks: DataFrame, size: int, sr: float, before: float = 0.05, after: float = 0.08, frames: int = 32, centre: bool = True, n_mels: int = 64) -> DataFrame:
    """clip, id, t, patch of every mark (clip, id, t): `kernels.mel_patch` at it, from blocks of `size` samples at rate sr with a halo of (before + after) sr + 1 samples behind.

    A mark's block is the one that its patch begins in; a mark beyond its clip's end, or of an unknown clip, has a patch of silence.
    """
    first = F.greatest(F.lit(0), F.bround((F.col("t") / 1e6 - before) * sr).cast("long"))
    listed = marks.select("clip", F.floor(first / size).alias("block"), F.struct("id", "t").alias("m")).groupBy("clip", "block").agg(F.collect_list("m").alias("marks"))
    met = listed.join(blocks, ["clip", "block"], "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("start", "own", "lead")})

    def kernel(_, block, start, own, lead, x, marks):
        base, found = start - lead, []
        for m in marks:
            t = m["t"] / 1e6
            a, b = round((t - before) * sr) - base, round((t + after) * sr) - base
            segment = np.zeros(max(0, b - a))
            low, high = max(a, 0), min(b, len(x))
            if high > low:
                segment[low - a : high - a] = x[low:high]
            found.append(kernels.patch(segment, sr, frames, centre, n_mels).astype(float).tolist())
        return [m["id"] for m in marks], [m["t"] for m in marks], pa.array(found, pa.list_(pa.list_(pa.float64())))

    return each_block(met, kernel, "id long, t long, patch array<array<double>>", ("marks",))


def _within(rows: DataFrame) -> DataFrame:
    return rows.withColumn("run", F.floor(F.col("at") / RUN))


def _bounded(at: int, most: int) -> None:
    if at >= most:
        raise ValueError(f"a clip of more than {most} blocks")


def carried_states(rest: DataFrame, size: int, sections: Callable[[float], np.ndarray]) -> DataFrame:
    """(clip, block, state): the filter's states before each block, from the states behind it when it began at rest: rest(clip, sr, block, state).

    A full block turns the states s before it into T s + its own, where T is the decay of `size` samples.  Runs of RUN blocks are
    scanned each on its own, then the runs' totals in the same way, whose map is T to the power RUN, and then every block is
    given what its run began with.
    """
    kind = _kind(rest)

    def scan(level: int):
        steps = size * RUN**level

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            _bounded(int(rows["at"].iloc[-1]) * RUN**level, RUN**LEVELS)
            step = kernels.decay(sections(float(rows["sr"].iloc[0])), steps)
            local, state = [], np.zeros(len(step))
            for own in rows["state"]:
                local.append(state)
                state = step @ state + np.asarray(own)
            total = [None] * (len(rows) - 1) + [state]
            return pd.DataFrame({"clip": list(rows["clip"]), "sr": rows["sr"].to_numpy(), "run": rows["run"].to_numpy(), "at": rows["at"].to_numpy(), "local": local, "total": total})

        return run

    def lead_in(level: int):
        steps = size * RUN**level

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in it:
                out = []
                for sr, at, local, before in zip(rows["sr"], rows["at"], rows["local"], rows["before"]):
                    out.append(local if before is None or not np.any(before) else local + kernels.decay(sections(float(sr)), steps * int(at % RUN)) @ before)
                yield pd.DataFrame({"clip": list(rows["clip"]), "at": rows["at"], "state": out})

        return run

    levels, rows = [], rest.select("clip", "sr", F.col("block").alias("at"), "state")
    for level in range(LEVELS):
        scanned = _within(rows).groupBy("clip", "run").applyInPandas(scan(level), f"{kind}, sr double, run long, at long, local array<double>, total array<double>")
        levels.append(scanned)
        rows = scanned.where("total is not null").select("clip", "sr", F.col("run").alias("at"), F.col("total").alias("state"))
    states = None
    for level in reversed(range(LEVELS)):
        x = levels[level]
        x = x.withColumn("before", F.lit(None).cast("array<double>")) if states is None else x.join(states.select("clip", F.col("at").alias("run"), F.col("state").alias("before")), ["clip", "run"])
        states = x.select("clip", "sr", "at", "local", "before").mapInPandas(lead_in(level), f"{kind}, at long, state array<double>")
    return states.select("clip", F.col("at").alias("block"), "state")


def bandpass(blocks: DataFrame, size: int, low: float, high: float, order: int = 4) -> DataFrame:
    """The blocks (without halo) behind the causal Butterworth band-pass, as `kernels.bandpass` filters whole clips."""
    def sections(sr: float) -> np.ndarray:
        return kernels.butter_band(order, low / (sr / 2), high / (sr / 2))

    def from_rest(sr, block, start, own, lead, x):
        s = sections(sr)
        _, state = kernels.filter_from(s, x, np.zeros((len(s), 2)))
        return [sr], [block], _rows(state.reshape(1, -1))

    def filtered(sr, block, start, own, lead, x, state):
        y, _ = kernels.filter_from(sections(sr), x, np.asarray(state).reshape(-1, 2))
        return [sr], [block], [start], [own], [lead], _rows(y.reshape(1, -1)) if len(y) else pa.array([[]], pa.list_(pa.float64()))

    states = carried_states(each_block(blocks, from_rest, "sr double, block long, state array<double>"), size, sections)
    return each_block(blocks.join(states, ["clip", "block"]), filtered, "sr double, block long, start long, own long, lead long, samples array<double>", ("state",))


def local_maxima(blocks: DataFrame, size: int) -> DataFrame:
    """(clip, idx, value) of strict local maxima; of a plateau the middle sample, the left one of two; ends are never maxima.

    A block decides the plateaus inside it.  One that reaches over an edge is a piece a block, and the pieces are put together.
    """
    def pieces(sr, block, start, own, lead, x):
        left, right = x[0] if lead else None, x[lead + own] if len(x) > lead + own else None
        v = x[lead : lead + own]
        begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        end = np.append(begin[1:], own) - 1
        h = v[begin]
        from_left, to_right = np.zeros(len(h), bool), np.zeros(len(h), bool)
        from_left[0], to_right[-1] = left is not None and left == h[0], right is not None and right == h[-1]
        up = np.concatenate([[left is not None and left < h[0]], h[:-1] < h[1:]])
        down = np.concatenate([h[1:] < h[:-1], [right is not None and right < h[-1]]])
        ok = (up | from_left) & (down | to_right)
        return start + begin[ok], start + end[ok], h[ok], from_left[ok], to_right[ok]

    found = each_block(halo(blocks, size, 1, 1), pieces, "lo long, hi long, value double, from_left boolean, to_right boolean")
    whole = found.where("not from_left and not to_right").select("clip", "lo", "hi", "value")
    cut = found.where("from_left or to_right")
    w = Window.partitionBy("clip").orderBy("lo")
    joins = F.col("from_left") & (F.lag("hi").over(w) == F.col("lo") - 1) & F.lag("to_right").over(w)
    chain = cut.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_chain", F.sum((~F.col("_joins")).cast("int")).over(w))
    met = chain.groupBy("clip", "_chain").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("value").alias("value"), F.min_by("from_left", "lo").alias("_l"), F.max_by("to_right", "lo").alias("_r"))
    every = whole.unionByName(met.where("not _l and not _r").select("clip", "lo", "hi", "value"))
    return every.select("clip", F.floor((F.col("lo") + F.col("hi")) / 2).cast("long").alias("idx"), "value")


def _past(x: np.ndarray, h: float) -> tuple[bool, float]:
    """(whether x has a sample above h, the least of the samples behind the last such one)."""
    above = np.flatnonzero(x > h)
    part = x[above[-1] + 1 :] if len(above) else x
    return bool(len(above)), float(part.min()) if len(part) else np.inf


def prominences(blocks: DataFrame, peaks: DataFrame, size: int) -> DataFrame:
    """(clip, idx, prominence) of every peak (clip, idx) of blocks without halo: `kernels.prominences` of the whole clip.

    A peak looks to both sides for a higher sample, and for the least one on the way.  What its own block doesn't end climbs:
    within a run of RUN blocks their extremes say in which block the higher sample is, and else the run is passed over as a whole;
    then it descends into the block found.  Only peaks that nothing in their block exceeds on a side climb at all.
    """
    kind = _kind(blocks)
    searched = f"{kind}, idx long, h double, side int, low double, at long, state string"
    names = ["clip", "idx", "h", "side", "low", "at", "state"]
    nodes = [each_block(blocks, lambda sr, block, start, own, lead, x: ([block], [x.max()], [x.min()]) if len(x) else None, "at long, top double, least double")]
    for _ in range(1, LEVELS):
        below = _within(nodes[-1])
        nodes.append(below.groupBy("clip", F.col("run").alias("at")).agg(F.max("top").alias("top"), F.min("least").alias("least")))

    def begin(sr, block, start, own, lead, x, places):
        out = []
        for p in places:
            i = p - start
            for side, part in ((-1, x[:i]), (1, x[i + 1 :][::-1])):
                found, low = _past(part, x[i])
                out.append((p, float(x[i]), side, min(low, float(x[i])), block, "done" if found else "up"))
        return [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.string()))]

    placed = peaks.select("clip", F.floor(F.col("idx") / size).alias("block"), "idx").groupBy("clip", "block").agg(F.array_sort(F.collect_set("idx")).alias("places"))
    queries = each_block(blocks.join(placed, ["clip", "block"]), begin, "idx long, h double, side int, low double, at long, state string", ("places",))

    def step(level: int, down: bool):
        def run(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("at")
            if not len(asked):
                return pd.DataFrame(columns=names)
            at, top, least = (nodes[c].to_numpy() for c in ("at", "top", "least"))
            _bounded(int(at[-1]) * RUN**level, RUN**LEVELS)
            out = []
            for clip, idx, h, side, low, place, _ in asked[names].itertuples(index=False):
                own = len(at) if down else np.searchsorted(at, place)
                # the nodes on the way, the nearest last; on the way down all of the run, from the side that the peak is on
                way = slice(0, own) if side < 0 else (slice(None, None, -1) if down else slice(len(at), own, -1))
                t, m, a = top[way], least[way], at[way]
                above = np.flatnonzero(t > h)
                last = above[-1] if len(above) else -1
                passed = m[last + 1 :]
                low = min(low, float(passed.min())) if len(passed) else low
                out.append((clip, idx, h, side, low, int(a[last]) if last >= 0 else int(place) // RUN, ("down" if level else "into") if last >= 0 else "up"))
            return pd.DataFrame(out, columns=names)

        return run

    def into(sr, block, start, own, lead, x, asked):
        out = [(q["idx"], q["h"], q["side"], min(q["low"], _past(x if q["side"] < 0 else x[::-1], q["h"])[1]), block, "done") for q in asked]
        return [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.string()))]

    def move(asked: DataFrame, level: int, down: bool) -> DataFrame:
        by = asked.withColumn("run", F.col("at")) if down else _within(asked)
        return by.groupBy("clip", "run").cogroup(_within(nodes[level]).groupBy("clip", "run")).applyInPandas(step(level, down), searched)

    done = queries.where("state = 'done'")
    up, descend = queries.where("state = 'up'"), []
    for level in range(LEVELS):
        moved = move(up, level, False)
        descend.append(moved.where("state <> 'up'"))
        up = moved.where("state = 'up'")
    # at the top, what was never exceeded has passed the whole clip
    below = None
    for level in reversed(range(LEVELS)):
        here = descend[level] if below is None else descend[level].unionByName(below)
        below = move(here, level - 1, True) if level else here
    listed = below.select("clip", F.col("at").alias("block"), F.struct("idx", "h", "side", "low").alias("q")).groupBy("clip", "block").agg(F.collect_list("q").alias("asked"))
    ended = each_block(blocks.join(listed, ["clip", "block"]), into, "idx long, h double, side int, low double, at long, state string", ("asked",))
    every = done.unionByName(up).unionByName(ended)
    return every.groupBy("clip", "idx").agg((F.max("h") - F.max("low")).alias("prominence"))
