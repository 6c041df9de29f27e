"""Weighted means over short arrays, newest value last."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Weights of the three newest values (newest first) and decay speeds.
SHORT_WEIGHTS = (0.65, 0.25, 0.10)
MEDIUM_DECAY = 0.15
RECENCY_LAMBDA = 0.4
HALF_LIFE = 3.0


def half_life_weights(length: Column, half_life: Column) -> Column:
    """Weights ``2 ** (-age / half_life)`` for ages length-1 .. 0, summing to one."""
    ages = F.transform(F.sequence(F.lit(1), length), lambda i: (length - i).cast("double"))
    raw = F.transform(ages, lambda age: F.exp(-age * F.lit(math.log(2.0)) / half_life))
    total = F.aggregate(raw, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(raw, lambda w: w / total)


def exponential_mean(values: Column, speed: float) -> Column:
    """Mean weighted by ``exp(-speed * age)``; null for an empty array."""
    count = F.size(values)
    weighted = F.transform(
        values,
        lambda v, i: F.struct(
            v.alias("v"), F.exp(F.lit(-speed) * (count - 1 - i).cast("double")).alias("w")
        ),
    )
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    return F.aggregate(
        weighted,
        start,
        lambda acc, x: F.struct((acc.s + x.v * x.w).alias("s"), (acc.w + x.w).alias("w")),
        lambda acc: F.when(acc.w > 0, acc.s / acc.w),
    )


def last_values(values: Column, n: int) -> Column:
    """The newest ``n`` values (``slice`` alone is empty when there are fewer)."""
    size = F.size(values)
    return F.slice(values, F.greatest(size - F.lit(n - 1), F.lit(1)), n)
