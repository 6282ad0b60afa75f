"""Heat-map kernels over flattened square maps, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def softmax(logits: Column) -> Column:
    """Softmax of an array."""

    def scaled(r: Column) -> Column:
        e = F.transform(r["v"], lambda v: F.exp(v.cast("double") - r["top"]))
        return _with(F.struct(e.alias("e"), _total(e).alias("s")), lambda q: F.transform(q["e"], lambda v: v / q["s"]))

    return _with(F.struct(logits.alias("v"), F.array_max(logits).cast("double").alias("top")), scaled)


def expected_coordinates(probability: Column, size: int) -> Column:
    """Struct x, y: expectations along both axes, from 0 to 1; rows of a map follow each other."""
    x = F.transform(probability, lambda p, i: p * (i % size) / (size - 1))
    y = F.transform(probability, lambda p, i: p * F.floor(i / size) / (size - 1))
    return F.struct(_total(x).alias("x"), _total(y).alias("y"))


def gaussian_map(x: Column, y: Column, size: int, sigma: float) -> Column:
    """A Gaussian about (x, y), from 0 to 1, on a square grid; it sums to 1."""
    at = F.sequence(F.lit(0), F.lit(size * size - 1))
    raw = F.transform(
        at, lambda i: F.exp(-(F.pow(i % size - x * (size - 1), 2) + F.pow(F.floor(i / size) - y * (size - 1), 2)) / (2 * sigma * sigma))
    )
    return _with(F.struct(raw.alias("e"), F.greatest(_total(raw), F.lit(1e-12)).alias("s")), lambda r: F.transform(r["e"], lambda v: v / r["s"]))


def smooth_l1(a: Column, b: Column, beta: float = 0.02) -> Column:
    d = F.abs(a - b)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def cross_entropy(target: Column, logits: Column) -> Column:
    """Minus the target-weighted log softmax."""
    weighted = _total(F.zip_with(target, logits, lambda t, v: t * v.cast("double")))
    total = lambda r: _total(F.transform(r["v"], lambda v: F.exp(v.cast("double") - r["top"])))
    norm = _with(F.struct(logits.alias("v"), F.array_max(logits).cast("double").alias("top")), lambda r: F.log(total(r)) + r["top"])
    return norm * _total(target) - weighted
