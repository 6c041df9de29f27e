"""As-of join: for each left row the latest right row of its key that is not later."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

MODES = ("upto", "before", "day")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_key: str,
    right_key: str,
    day: str,
    number: str,
    values: Sequence[str],
    prefix: str = "asof_",
    mode: str = "upto",
) -> DataFrame:
    """Add ``prefix + value`` columns from the latest matching right row, null when there is none.

    ``mode``: ``upto`` takes right rows with (day, number) <= the left row's, ``before`` only
    earlier days, ``day`` the last right row of the latest day <= the left day.

    The lookback is unbounded, yet no key is handled as one group: right rows are reduced to
    one state per (key, day), the carry runs over days, and only rows of one day are ordered
    by number.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    stats = right.select(
        F.col(right_key).alias("_key"), F.col(day).alias("_day"), F.col(number).alias("_num"),
        F.struct(*values).alias("_val"),
    )
    wanted_days = left.select(F.col(left_key).alias("_key"), F.col(day).alias("_day")).distinct()
    last_of_day = stats.groupBy("_key", "_day").agg(F.max_by("_val", "_num").alias("_last"))
    days = (
        last_of_day.unionByName(wanted_days, allowMissingColumns=True)
        .groupBy("_key", "_day").agg(F.max_by("_last", F.col("_last").isNotNull()).alias("_last"))
    )
    upper = 0 if mode == "day" else -1
    frame = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, upper)
    carried = days.select(
        F.col("_key").alias(left_key), F.col("_day").alias(day),
        F.last("_last", ignorenulls=True).over(frame).alias("_carried"),
    )
    base = left
    found = F.col("_carried")
    if mode == "upto":
        base = _latest_within_day(left, stats, left_key, day, number)
        found = F.coalesce("_today", "_carried")
    joined = base.join(carried.hint("merge"), [left_key, day], "left")  # as large as the history
    picked = [found.getField(v).alias(prefix + v) for v in values]
    return joined.select(*[F.col(c) for c in left.columns], *picked)


def _latest_within_day(left: DataFrame, stats: DataFrame, key: str, day: str, number: str) -> DataFrame:
    rows = left.withColumn("_is_left", F.lit(1))
    lookups = stats.select(
        F.col("_key").alias(key), F.col("_day").alias(day), F.col("_num").alias(number), "_val",
        F.lit(0).alias("_is_left"),
    )
    both = rows.unionByName(lookups, allowMissingColumns=True)
    frame = (
        Window.partitionBy(key, day).orderBy(number, "_is_left")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        both.withColumn("_today", F.last("_val", ignorenulls=True).over(frame))
        .filter("_is_left = 1").drop("_is_left", "_val")
    )
