"""Scoring of candidates, and training of the logistic score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import clip, logit_score, sigmoid
from tidemark.operators.matching import anti, asof_nearest, label


def logreg_score(df: DataFrame, features: str, model: dict, name: str = "score") -> DataFrame:
    return df.withColumn(name, logit_score(F.col(features), model["weights"], model["bias"], model["mean"], model["std"]))


def weighted_score(features: dict[str, float], penalties: dict[str, float] | None = None) -> Column:
    """An optional hand-weighted score: sum of column x weight, less each penalty whose flag column is true."""
    out = F.lit(0.0)
    for c, w in features.items():
        out = out + F.col(c) * w
    for c, w in (penalties or {}).items():
        out = out - F.when(F.col(c), F.lit(w)).otherwise(0.0)
    return out


def choose_scorer(network: bool, network_only: bool, logreg: bool) -> str:
    """Which scorer runs; it is recorded in the result instead of falling back in silence."""
    return "network" if network_only and network else "logreg" if logreg else "none"


def fingerprint_confidence(df: DataFrame, whole: bool = False) -> DataFrame:
    """Adds confidence from score, attack_norm, e_high_ratio, e_low_ratio and cluster: half the sigmoid of the robust z of the
    score with its bonus, half the sigmoid of its lead over the cluster's median in steps of 0.15.

    With `whole`, the medians are taken where a clip's rows meet in one task, as those of a clip that came as one row may, so that rows are read and shuffled once, not for each
    median and for what they are joined to.
    """
    bonus = 0.08 * clip(F.col("attack_norm"), 0.0, 1.0) + 0.05 * clip(F.col("e_high_ratio"), 0.0, 1.0) + 0.05 * clip(F.col("e_low_ratio"), 0.0, 1.0)
    x = df.withColumn("score", F.col("score") + bonus)
    median = lambda c: F.expr(f"percentile({c}, 0.5)")
    if whole:
        own = Window.partitionBy("clip")
        x = x.where("clip is not null").withColumn("_med", median("score").over(own)).withColumn("_dev", F.abs(F.col("score") - F.col("_med")))
        x = x.withColumn("_mad", median("_dev").over(own)).withColumn("_inner", median("score").over(Window.partitionBy("clip", "cluster")))
    else:
        med = x.groupBy("clip").agg(median("score").alias("_med"))
        x = x.join(med, "clip").withColumn("_dev", F.abs(F.col("score") - F.col("_med")))
        mad = x.groupBy("clip").agg(median("_dev").alias("_mad"))
        inner = x.groupBy("clip", "cluster").agg(median("score").alias("_inner"))
        x = x.join(mad, "clip").join(inner, ["clip", "cluster"])
    z = (F.col("score") - F.col("_med")) / ((F.col("_mad") + 1e-9) * 1.4826 + 1e-9)
    conf = 0.5 * sigmoid(clip(z, -5.0, 5.0)) + 0.5 * sigmoid((F.col("score") - F.col("_inner")) / 0.15)
    return x.withColumn("confidence", conf).drop("_med", "_dev", "_mad", "_inner")


def fuse(confidence: Column, network: Column, weight: float = 0.5) -> Column:
    """(1 - weight) x confidence + weight x the network's probability; the confidence alone without one."""
    return F.coalesce((1 - weight) * confidence + weight * network, confidence)


def logreg_train(df: DataFrame, features: str, target: str, weight: str | None = None, lr: float = 0.1, epochs: int = 2000, l2: float = 1e-3, block_bytes: int = 1 << 26, leg: int = 250) -> dict:
    """Weights by full-batch gradient descent on the weighted log loss over n, with the L2 penalty on the weights alone.

    Epochs run in barrier stages of `leg` each, from the weights that the leg before left: a task holds its rows as a matrix of about block_bytes (more only if
    the cluster has fewer cores than that needs), and in every epoch the tasks exchange one gradient each, features numbers whatever the rows.  A lost task
    restarts its leg, not the training; the rows are kept for all legs, on disk where memory is short.
    """
    size = df.select(F.size(features)).where(f"{features} is not null").first()
    d = size[0] if size else 0
    x = df.where(F.col(features).isNotNull() & F.col(target).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    stats = x.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = stats["n"]
    if not n:
        return {"type": "binary", "weights": [0.0] * d, "bias": 0.0, "mean": [0.0] * d, "std": [0.0] * d}
    mean, std = np.array([stats[f"m{i}"] for i in range(d)]), np.array([stats[f"s{i}"] for i in range(d)])
    scale = np.where(std < 1e-6, 1.0, std)
    tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-n * (d + 2) * 8 // block_bytes)))

    def descend(w: np.ndarray, b: float, epochs: int):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [((np.stack(p["x"]) - mean) / scale, p["y"].to_numpy(), p["w"].to_numpy()) for p in it if len(p)]
            m, y, u = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros((0, d)), np.zeros(0), np.zeros(0))
            context = BarrierTaskContext.get()
            now, bias = w, b
            for _ in range(epochs):
                e = (1 / (1 + np.exp(-(m @ now + bias))) - y) * u
                g = np.append(m.T @ e, e.sum())
                if tasks > 1:
                    g = np.sum([np.frombuffer(bytes.fromhex(x)) for x in context.allGather(g.tobytes().hex())], axis=0)
                now, bias = now - lr * (g[:d] / n + l2 * now), bias - lr * g[d] / n
            if context.partitionId() == 0:
                yield pd.DataFrame({"w": [now.tolist()], "b": [float(bias)]})

        return run

    rows = x.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    w, bias = np.zeros(d), 0.0
    for done in range(0, epochs, leg):
        found = rows.mapInPandas(descend(w, bias, min(leg, epochs - done)), "w array<double>, b double", barrier=True).first()
        w, bias = np.array(found.w), found.b
    rows.unpersist()
    return {"type": "binary", "weights": w.tolist(), "bias": bias, "mean": mean.tolist(), "std": std.tolist()}


def training_set(candidates: DataFrame, refs: DataFrame, before: int, after: int, miss_weight: float = 4.5, synthesized: DataFrame | None = None) -> DataFrame:
    """clip, id, t, features, label, weight: every candidate with its label; for each reference that no candidate of its own covers, the nearest
    candidate as a heavier positive; and, if given, rows computed at the references (clip, id, t, features), heavier too."""
    base = label(candidates, refs, before, after).withColumn("weight", F.lit(1.0))
    missed = anti(refs.select("clip", "id", "t"), candidates, before, after)
    near = asof_nearest(missed, candidates.select("clip", "id", "t", "features"))
    extra = near.where("near is not null").select("clip", F.col("near.id").alias("id"), F.col("near.t").alias("t"), F.col("near.features").alias("features"), F.lit(1).alias("label"), F.lit(miss_weight).alias("weight"))
    out = base.select("clip", "id", "t", "features", "label", "weight").unionByName(extra)
    if synthesized is not None:
        out = out.unionByName(synthesized.select("clip", "id", "t", "features", F.lit(1).alias("label"), F.lit(miss_weight).alias("weight")))
    return out


def network_scores(df: DataFrame, patch: str, load) -> DataFrame:
    """Adds network: probabilities from `load()`, called once for each task, which returns a function from a batch of patches to scores."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for p in it:
            yield p.assign(network=score(np.stack(p[patch])) if len(p) else np.zeros(0))

    return df.mapInPandas(run, f"{fields}, network double")


def shell_features(scores: DataFrame, offset: int, norm: float = 0.08) -> DataFrame:
    """(clip, id, features): eight shares from each window's frame scores (idx from 0; frames from `offset` on are after the shot)."""
    after, v = F.col("idx") >= offset, F.col("value")
    g = scores.groupBy("clip", "id").agg(
        F.coalesce(F.max(F.when(~after, v)), F.lit(0.0)).alias("b"), F.coalesce(F.max(F.when(after, v)), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.when(after, v)), F.lit(0.0)).alias("m"),
        F.max(F.struct("value", (-F.col("idx")).alias("k"))).alias("top"), F.count("*").alias("n"), F.collect_list(F.when(after, v)).alias("xs"),
    )
    active = F.size(F.filter("xs", lambda x: x > F.greatest(F.col("b") * 1.5, F.lit(1e-5)))) / F.greatest(F.size("xs"), F.lit(1))
    peak = -F.col("top.k")
    one = F.lit(1.0)
    spike = F.col("a") / (F.col("b") + 1e-6)
    parts = [F.least(one, F.col("a") / norm), F.least(one, F.col("b") / norm), F.least(one, (F.col("a") - F.col("b")) / norm), F.least(one, F.col("m") / norm), (peak >= offset).cast("double"), active, peak / F.greatest(F.col("n") - 1, F.lit(1)), F.least(one, F.greatest(F.lit(0.0), spike - 1) / 5)]
    return g.select("clip", "id", F.array(*[p.cast("double") for p in parts]).alias("features"))


def negative_windows(clips: DataFrame, shots: DataFrame, length: int, apart: int) -> DataFrame:
    """Windows of `length` in steps of half of it, ending before the clip does, whose centre is `apart` or more from every shot; of
    these every (n // shots)-th, at most one for each shot.  clips: clip, duration; all in microseconds."""
    half = length // 2
    grid = clips.where(F.col("duration") > length).select("clip", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("duration") - length - 1, F.lit(half).cast("long"))).alias("id", "start"))
    centre = grid.select("clip", F.col("id").cast("long").alias("id"), "start", (F.col("start") + half).alias("t"))
    free = anti(centre, shots, apart - 1, apart - 1)
    n = shots.groupBy("clip").agg(F.count("*").alias("_want"))
    w = Window.partitionBy("clip")
    x = free.join(n, "clip").withColumn("_k", F.row_number().over(w.orderBy("start")) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_want")))
    return x.where((F.col("_k") % step == 0) & (F.col("_k") / step < F.col("_want"))).select("clip", "start", (F.col("start") + length).alias("end"))


def random_negatives(clips: DataFrame, beeps: DataFrame, per_clip: int, margin: int, length: int, seed: int = 42) -> DataFrame:
    """(clip, id, t): `per_clip` seeded draws of a start time, those within the margin of a beep left out.

    Draws come from the MD5 of clip, number and seed, so a rerun gives the same rows.
    """
    draws = clips.select("clip", "duration", F.explode(F.sequence(F.lit(0), F.lit(per_clip - 1))).alias("id"))
    digest = F.left(F.md5(F.concat_ws("|", F.col("clip").cast("string"), F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), F.lit(13))
    u = F.conv(digest, 16, 10).cast("double") / float(1 << 52)
    at = draws.where(F.col("duration") > length).select("clip", F.col("id").cast("long").alias("id"), F.floor(u * (F.col("duration") - length)).cast("long").alias("t"))
    return anti(at, beeps, margin, margin)
