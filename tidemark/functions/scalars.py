"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return ratio(2 * p * r, p + r)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def frame_of(t_us: Column, fps, how: str = "floor") -> Column:
    """Frame number of a time: floor or round (half away from zero)."""
    x = t_us.cast("double") * F.lit(fps) / 1e6
    return (F.floor(x) if how == "floor" else F.round(x)).cast("long")


def rational_fps(rate: Column) -> Column:
    """"num/den" as frames a second; 30 for an empty rate or a zero denominator.  A plain number is itself."""
    num = F.split_part(rate, F.lit("/"), F.lit(1)).try_cast("double")
    den = F.split_part(rate, F.lit("/"), F.lit(2)).try_cast("double")
    whole = F.when(F.instr(rate, "/") == 0, F.lit(1.0)).otherwise(den)
    return F.when(num.isNull() | F.coalesce(whole, F.lit(0.0)).eqNullSafe(F.lit(0.0)), F.lit(30.0)).otherwise(num / whole)


def nearest_rank(xs: Column, q: float) -> Column:
    """Element number round-half-even(q (n - 1)) of the sorted array, as for p10 and p90."""
    xs = F.array_sort(xs)
    return F.element_at(xs, (F.bround(F.lit(q) * (F.size(xs) - 1), 0) + 1).cast("int"))


def middle(xs: Column) -> Column:
    """Element number n // 2 of the sorted array."""
    xs = F.array_sort(xs)
    return F.element_at(xs, (F.floor(F.size(xs) / 2) + 1).cast("int"))


def logit_score(features: Column, weights: list[float], bias: float, mean: list[float], std: list[float]) -> Column:
    """Logistic regression over standardised features; a deviation below 1e-6 counts as 1."""
    scale = [s if s >= 1e-6 else 1.0 for s in std]
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    z = F.zip_with(F.zip_with(features, arr(mean), lambda x, m: x - m), arr(scale), lambda x, s: x / s)
    return sigmoid(F.aggregate(F.zip_with(z, arr(weights), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) + F.lit(float(bias)))
