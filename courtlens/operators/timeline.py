"""Ordered computations per key that stay even when one key owns most rows.

Two tools cover every history feature:

* ``history_columns`` - frames of a fixed number of rows. A key with more rows than fit one
  task is cut into runs of whole days; each run also gets the few earlier days its frames
  reach back to. Keys of ordinary size take a plain window with no extra shuffle.
* ``before_each_day`` - unbounded "everything before this date" state. Rows are reduced per
  (key, day) first; the running part then works on one row per day of the calendar.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from courtlens.session import cut_lineage

ROWS_PER_RUN = 2_000_000
BROADCAST_ROWS = 200_000


def _long_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)


def _runs_of_days(per_day: DataFrame, keys: Sequence[str], day: str, reach: int, limit: int) -> DataFrame:
    """One row per (key, day) of the long keys: the run it belongs to and the runs it warms up."""
    by_day = Window.partitionBy(*keys).orderBy(day)
    counted = per_day.withColumn(
        "_end", F.sum("_n").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_run", F.floor((F.col("_end") - F.col("_n")) / limit))
    starts_next = F.lead("_run").over(by_day)
    marked = counted.withColumn("_next", F.when(starts_next != F.col("_run"), starts_next))
    # a run starts where the previous day ends; a day warms up every run starting < reach rows later
    ahead = Window.partitionBy(*keys).orderBy("_end").rangeBetween(0, max(reach - 1, 0))
    warmed = F.collect_list("_next").over(ahead) if reach > 0 else F.array().cast("array<bigint>")
    return marked.select(*keys, day, F.concat(F.array("_run"), warmed).alias("_runs"))


def spread_long_keys(
    df: DataFrame, keys: Sequence[str], day: str, reach: int, rows_per_run: int | None = None
) -> tuple[DataFrame, list[str]]:
    """``df`` with ``_run`` and ``_own`` columns where some key is long, else unchanged.

    Returns the frame and the columns to partition windows by. Rows with ``_own`` false are
    only there for frames to reach back to and are dropped by the caller.
    """
    limit = ROWS_PER_RUN if rows_per_run is None else rows_per_run
    keys = list(keys)
    long_keys = _long_keys(df.select(*keys), keys, limit)
    found = long_keys.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return df, keys
    small = found <= BROADCAST_ROWS
    keep = F.broadcast(long_keys) if small else long_keys
    per_day = (
        df.select(*keys, day).join(keep.select(*keys), keys, "left_semi")
        .groupBy(*keys, day).agg(F.count(F.lit(1)).alias("_n"))
    )
    runs = _runs_of_days(per_day, keys, day, reach, limit)
    if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    tagged = (
        df.join(runs, [*keys, day], "left")
        .withColumn("_runs", F.coalesce("_runs", F.array(F.lit(0).cast("bigint"))))
        .select("*", F.posexplode("_runs").alias("_copy", "_run"))
        .withColumn("_own", F.col("_copy") == 0)
        .drop("_runs", "_copy")
    )
    return tagged, [*keys, "_run"]


def history_columns(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    order: Sequence[str],
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]],
    rows_per_run: int | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``reach`` rows back.

    ``build`` gets the ordered window and returns the new columns, or several steps of them where
    later ones use earlier ones; all of them share one sort.
    ``derive`` adds columns that follow from the row alone; it runs after the rows were dealt by key,
    so that those columns are not shuffled.
    """
    spread, parts = spread_long_keys(df, keys, day, reach, rows_per_run)
    columns = df.columns
    if derive is not None:
        columns, spread = derive(df).columns, derive(spread.repartition(*parts))
    if "_own" in spread.columns:
        spread = spread.select(*columns, "_own", "_run")
    window = Window.partitionBy(*parts).orderBy(*order)
    steps = build(window)
    for step in [steps] if isinstance(steps, dict) else steps:
        spread = spread.select("*", *[c.alias(name) for name, c in step.items()])
    return spread.filter("_own").drop("_own", "_run") if "_own" in spread.columns else spread


def longer_sums(w: WindowSpec, parts: dict[str, str], size: int, unit: int) -> dict[str, Column]:
    """Sums over the previous ``size`` rows, null without any, from columns with those over ``unit`` rows.

    A frame is summed anew at every row; looking up sums of earlier rows is one step each.
    """
    return {name: sum((F.coalesce(F.lag(part, back).over(w), F.lit(0.0)) for back in range(unit, size, unit)), F.col(part))
            for name, part in parts.items()}


def rows_before(w: WindowSpec, size: int) -> Column:
    """How many of the previous ``size`` rows there are; null where there are none."""
    return F.nullif(F.least(F.row_number().over(w) - 1, F.lit(size)), F.lit(0))


def before_each_day(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    per_day: dict[str, Column],
    running: Callable[[WindowSpec], dict[str, Column]],
    first: int = Window.unboundedPreceding,
) -> DataFrame:
    """State from strictly earlier days, one row per (key, day).

    ``per_day`` aggregates the rows of a day; ``running`` combines the days before it and gets
    a window whose frame ends at the previous day.
    """
    days = df.groupBy(*keys, day).agg(*[c.alias(name) for name, c in per_day.items()])
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(first, -1)
    return days.select(*keys, day, *[c.alias(name) for name, c in running(earlier).items()])


def with_day_state(df: DataFrame, state: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Attach per-day state to the rows; joins on (key, day), so a long key spreads over days.

    The state grows with the history and may hold lists, whose size the optimizer cannot see: it is
    never sent whole through the driver.
    """
    return df.join(state.hint("merge"), [*keys, day], "left")


def among(df: DataFrame, wanted: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """The rows of ``df`` whose keys are in ``wanted``, a stored table without repeated keys. A few keys go to every
    task, so that no other row is shuffled; they are counted first, and many are joined by a shuffle. Null keys meet."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = wanted.withColumnsRenamed({k: f"_wanted_{k}" for k in keys})
    same = [df[k].eqNullSafe(named[f"_wanted_{k}"]) for k in keys]
    return df.join(F.broadcast(named) if few else named, same, how).drop(*[f"_wanted_{k}" for k in keys])


def in_ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` in contiguous ranges of a total order, numbered from below by ``_range``.

    Bounds come from a sample of the whole order, later columns included, so ranges are about equal
    however often one leading value occurs. The result is materialised: bounds sampled again could
    differ from those that ranges were counted with.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def global_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position in a total order, without sorting everything in one task: rows are numbered
    inside their range and counts per range give the offsets."""
    ranged = in_ranges(df, order)
    # one row per range, of which there are as many as shuffle partitions
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return ranged.withColumn("_inside", F.row_number().over(inside)).join(offsets, "_range").withColumn(
        name, F.col("_offset") + F.col("_inside")).drop("_range", "_inside", "_offset")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, position: str = "recent_no") -> DataFrame:
    """The newest ``n`` rows per key, numbered from 1 = newest.

    The limit on ``row_number`` is applied before the shuffle as well, so a long key ships
    at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given total order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_no", F.row_number().over(window)).filter("_no = 1").drop("_no")
