"""What the two vector operators share: usable vectors, and pairs of blocks brought together."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    value = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))
