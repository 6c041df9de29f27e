"""Style clusters with stored centres: fitted by fixed rounds of means, given out by nearest centre.

The start is no random draw: rows are dealt to four groups by the signs of two standardised rates.
Every round is one aggregate over a narrow table and brings back four rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from courtlens.plans.scoring import STYLE_INPUT, STYLES, Scaler, fit_static_scaler
from courtlens.session import cut_lineage

ROUNDS = 8
#: The two rates whose signs make the first four groups.
START = ("player_ace_rate_roll30", "player_1st_win_pct_roll30")
#: Clusters are numbered by the sum of these, ascending.
STRENGTH = ("player_1st_win_pct_roll30", "player_2nd_win_pct_roll30")


@dataclass(frozen=True)
class Styles:
    """Scaler of the six rates and the centres in scaled units, in the order of their numbers."""

    scaler: Scaler
    centres: tuple[tuple[float, ...], ...]

    def add(self, df: DataFrame, name: str = "player_style_cluster") -> DataFrame:
        """``df`` with the number of the nearest centre, the smaller one at equal distance; a
        missing rate counts as 0. Scaled rates are columns of a step of their own, so that they are
        computed once and not for every centre."""
        scaled = {f"_z{i}": self.scaler.of(c, F.coalesce(c, F.lit(0.0))) for i, c in enumerate(STYLE_INPUT)}
        return df.withColumns(scaled).withColumn(name, nearest([F.col(z) for z in scaled], self.centres)).drop(*scaled)


def nearest(values: list[Column], centres) -> Column:
    if not centres:
        return F.lit(0)
    away = [F.struct(reduce(lambda a, b: a + b, [(v - F.lit(x)) * (v - F.lit(x)) for v, x in zip(values, centre)]).alias("d"), F.lit(i).alias("i"))
            for i, centre in enumerate(centres)]
    return F.array_min(F.array(*away)).getField("i")


def fit(train: DataFrame, rounds: int = ROUNDS, stage=cut_lineage) -> Styles:
    """Styles of the training rows; no rows give no centres, and then everyone is in cluster 0.

    Every round reads the scaled rates; ``stage`` stores them. Rows that are stored already need none.
    """
    filled = train.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in STYLE_INPUT])
    scaler = fit_static_scaler(filled, STYLE_INPUT)
    rows = stage(filled.select(*[scaler.of(c, F.col(c)).alias(c) for c in STYLE_INPUT]))
    values = [F.col(c) for c in STYLE_INPUT]
    first = (F.col(START[0]) >= 0).cast("int") * 2 + (F.col(START[1]) >= 0).cast("int")
    centres = _means(rows, first, [(0.0,) * len(STYLE_INPUT)] * STYLES)
    if centres is None:
        return Styles(scaler, ())
    for _ in range(rounds):
        centres = _means(rows, nearest(values, centres), centres)
    strength = [STYLE_INPUT.index(c) for c in STRENGTH]
    return Styles(scaler, tuple(sorted(centres, key=lambda c: sum(c[i] for i in strength))))


def _means(rows: DataFrame, group: Column, before: list) -> list | None:
    """Mean of each group; a group without rows keeps the centre it had."""
    found = rows.groupBy(group.alias("_i")).agg(*[F.avg(c).alias(c) for c in STYLE_INPUT]).collect()  # four rows
    means = {r["_i"]: tuple(r[c] for c in STYLE_INPUT) for r in found}
    return [means.get(i, c) for i, c in enumerate(before)] if means else None

