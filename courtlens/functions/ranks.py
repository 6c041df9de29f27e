"""Rank transforms and rank buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_RANK = 2000.0

# Rank buckets (label, lowest, highest) used by the reports.
BUCKETS_FIVE = (
    ("Top 10", 1, 10), ("11-25", 11, 25), ("26-50", 26, 50), ("51-100", 51, 100), ("101+", 101, 1000),
)
BUCKETS_FIVE_WIDE = (
    ("Top 10", 1, 10), ("11-25", 11, 25), ("26-50", 26, 50), ("51-100", 51, 100), ("100+", 101, 2000),
)
BUCKETS_SIX = (
    ("Top 5", 1, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("51-100", 51, 100),
    ("100+", 101, 1000),
)
BUCKETS_QUALITY = (
    ("Top 10", None, 10), ("11-20", None, 20), ("21-50", None, 50), ("51-100", None, 100),
    ("100+", None, None),
)
BUCKETS_PAIR = (
    ("1-5", 1, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("51-100", 51, 100),
    ("101+", 101, None),
)


def rank_strength(rank: Column, max_rank: float = MAX_RANK) -> Column:
    """Log-rank strength in [0, 1]; unranked players have 0."""
    value = F.lit(1.0) - F.ln(F.greatest(rank.cast("double"), F.lit(1.0))) / F.ln(F.lit(max_rank))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(rank > 0, clamped).otherwise(F.lit(0.0))


def bucket_of(rank: Column, buckets, unranked: str | None = None) -> Column:
    """Label of the first bucket the rank falls in; null or ``unranked`` without a rank."""
    label = F.lit(None).cast("string")
    for name, low, high in reversed(buckets):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (rank >= low)
        if high is not None:
            inside = inside & (rank <= high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    missing = F.lit(unranked).cast("string")
    return F.when(rank.isNull() | (rank == 0), missing).otherwise(label)


def inverse_rank(rank: Column) -> Column:
    """``1 / rank`` with unranked opponents taken as 1000."""
    value = F.coalesce(rank.cast("double"), F.lit(1000.0))
    return F.when(value > 0, F.lit(1.0) / value).otherwise(F.lit(0.0))


def normalised_rank(rank: Column) -> Column:
    """``1 / (1 + rank)``; unknown beyond rank 1000."""
    value = rank.cast("double")
    return F.when((value != 0) & (value <= 1000), F.lit(1.0) / (F.lit(1.0) + value))


def difficulty(rank: Column) -> Column:
    """``100 - rank`` for opponents inside the top 100, else 0."""
    value = F.coalesce(F.nullif(rank.cast("double"), F.lit(0.0)), F.lit(1000.0))
    return F.when(value <= 100, F.lit(100.0) - value).otherwise(F.lit(0.0))


def inverted_axis(rank: Column) -> Column:
    """``200 - rank`` with unranked opponents (999) at 0."""
    value = F.coalesce(F.nullif(rank.cast("double"), F.lit(0.0)), F.lit(999.0))
    return F.when(value == 999, F.lit(0.0)).otherwise(F.lit(200.0) - value)


def rank_bonus(player_rank: Column, opponent_rank: Column, won: Column) -> Column:
    """Small bonus for beating strong opponents, penalty for losing to weak ones."""
    opp = opponent_rank.cast("double")
    win = (
        F.when(opp <= 5, 0.02).when(opp <= 10, 0.015).when(opp <= 20, 0.01)
        .when(opp <= 50, 0.005).when(opp <= 100, 0.0025)
        .otherwise(F.greatest(F.lit(0.0), F.lit(-0.0025) * (opp - 100) / 100))
    )
    loss = (
        F.when(opp > 100, -0.02).when(opp > 50, -0.015).when(opp > 20, -0.01)
        .when(opp > 10, -0.005).when(opp > 5, -0.0025).otherwise(0.0)
    )
    known = player_rank.isNotNull() & opponent_rank.isNotNull()
    return F.when(known & won, win).when(known, loss).otherwise(F.lit(0.0))
