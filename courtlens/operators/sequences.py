"""Fixed-length histories as arrays of structs, oldest step first."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.functions import decay, rates
from courtlens.operators.timeline import history_columns, with_day_state

DAY = "tourney_date"
NUM = "match_num"
ORDER = (DAY, NUM)
SEQ_LEN = 10


def _clean(fields: Sequence[str]) -> Column:
    return F.struct(*[rates.finite_or_zero(F.col(f)).alias(f) for f in fields])


def row_sequences(df: DataFrame, fields: Sequence[str], n: int = SEQ_LEN, rows_per_run: int | None = None, derive=None) -> DataFrame:
    """The previous ``n`` rows of the player as ``sequence``; rows with fewer are dropped. ``derive``
    may add fields after the rows are dealt by player."""

    def build(w):
        return {"sequence": F.collect_list(_clean(fields)).over(w.rowsBetween(-n, -1))}

    out = history_columns(df, ["player"], DAY, ORDER, n, build, rows_per_run, derive)
    return out.filter(F.size("sequence") == n).withColumn("mask", F.array_repeat(F.lit(1.0), n))


def strict_history(df: DataFrame, fields: Sequence[str], n: int = SEQ_LEN, name: str = "history") -> DataFrame:
    """The last ``n`` rows of the player with a strictly earlier date.

    Each day keeps at most its last ``n`` rows; the last ``n`` earlier days always hold the last
    ``n`` earlier rows, so neither a career nor a crowded day is ever collected.
    """
    back = Window.partitionBy("player", DAY).orderBy(F.col(NUM).desc())
    step = F.struct(F.col(NUM).alias("_num"), F.col(DAY).alias("_day"), *fields)
    tails = df.select("player", DAY, step.alias("_step"), F.row_number().over(back).alias("_back")).filter(
        F.col("_back") <= n)
    days = tails.groupBy("player", DAY).agg(F.array_sort(F.collect_list("_step")).alias("_tail"))
    earlier = Window.partitionBy("player").orderBy(DAY).rowsBetween(-n, -1)
    state = days.select(
        "player", DAY, decay.last_values(F.flatten(F.collect_list("_tail").over(earlier)), n).alias(name))
    return with_day_state(df, state, ["player"], DAY)


def mask_of(size: Column, n: int = SEQ_LEN) -> Column:
    """0 for padding on the left, 1 for real steps."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i > F.lit(n) - size).cast("double"))


def left_padded(steps: Column, fields: Sequence[str], n: int = SEQ_LEN) -> Column:
    blank = F.struct(*[F.lit(0.0).alias(f) for f in fields])
    return F.concat(F.array_repeat(blank, F.lit(n) - F.size(steps)), steps)


def decayed_steps(history: Column, use_rank: bool = True) -> Column:
    """Steps with decayed serve form; every step only uses the steps before it in the window.

    The first step has nothing before it and stands for itself. One pass: the exponential means
    carry a weighted sum and its weight, the short means the three newest values.
    """
    newest, middle, oldest = decay.SHORT_WEIGHTS
    medium_keep, recent_keep = math.exp(-decay.MEDIUM_DECAY), math.exp(-decay.RECENCY_LAMBDA)
    names = RANK_STEP if use_rank else NO_RANK_STEP
    step_type = "array<struct<" + ",".join(f"{n}:double" for n in names) + ">>"
    sums = ("medium",) if use_rank else ("medium", "rpw", "net")
    kept = ("v1", "v2", "v3") if use_rank else ("v1", "v2", "v3", "r1", "r2", "r3")

    start = F.struct(
        F.lit(0).alias("n"), *[F.lit(0.0).alias(k) for k in kept],
        *[F.lit(0.0).alias(f"{k}_{part}") for k in sums for part in ("sum", "weight")],
        F.array().cast(step_type).alias("steps"))

    def merge(acc: Column, x: Column) -> Column:
        first = acc.n == 0

        def mean(k: str, own: Column) -> Column:
            return F.when(first, own).otherwise(acc.getField(f"{k}_sum") / acc.getField(f"{k}_weight"))

        def grown(k: str, keep: float, own: Column) -> list[Column]:
            return [(acc.getField(f"{k}_sum") * keep + own).alias(f"{k}_sum"),
                    (acc.getField(f"{k}_weight") * keep + 1.0).alias(f"{k}_weight")]

        a, b, c = acc.v1, acc.v2, acc.v3
        short = (
            F.when(first, x.adj_serve).when(acc.n == 1, a)
            .when(acc.n == 2, (F.lit(oldest) * b + F.lit(middle) * a) / F.lit(middle + oldest))
            .otherwise((F.lit(oldest) * c + F.lit(middle) * b + F.lit(newest) * a) / F.lit(newest + middle + oldest)))
        medium = mean("medium", x.adj_serve)
        values = {"adj_serve_short_decay": short, "adj_serve_medium_decay": medium, "form_delta_serve": short - medium,
                  "surface_idx": x.surface_idx.cast("double"), "days_since_prev": x.days_since_prev}
        state = [(acc.n + 1).alias("n"), x.adj_serve.alias("v1"), a.alias("v2"), b.alias("v3")]
        sums_now = grown("medium", medium_keep, x.adj_serve)
        if use_rank:
            values["opponent_rank_norm"] = x.opp_rank_norm
        else:
            r1, r2, r3 = acc.r1, acc.r2, acc.r3
            q = recent_keep
            values["rpw_adj_last3"] = (
                F.when(first, x.adj_rpw).when(acc.n == 1, r1).when(acc.n == 2, (r1 + r2 * q) / (1 + q))
                .otherwise((r1 + r2 * q + r3 * (q * q)) / (1 + q + q * q)))
            # a window holds at most ten steps, so all of the steps before are the last ten
            values["rpw_adj_last10"] = mean("rpw", x.adj_rpw)
            values["net_skill_last10"] = mean("net", x.net_skill)
            state += [x.adj_rpw.alias("r1"), r1.alias("r2"), r2.alias("r3")]
            sums_now += grown("rpw", recent_keep, x.adj_rpw) + grown("net", recent_keep, x.net_skill)
        step = F.struct(*[values[n].alias(n) for n in names])
        return F.struct(*state, *sums_now, F.concat(acc.steps, F.array(step)).alias("steps"))

    return F.aggregate(history, start, merge, lambda acc: acc.steps)


RANK_STEP = ("adj_serve_short_decay", "adj_serve_medium_decay", "opponent_rank_norm", "surface_idx",
             "days_since_prev", "form_delta_serve")
NO_RANK_STEP = ("adj_serve_short_decay", "adj_serve_medium_decay", "surface_idx", "days_since_prev",
                "form_delta_serve", "rpw_adj_last10", "rpw_adj_last3", "net_skill_last10")


def last_valid(sequence: Column, mask: Column, field: str) -> Column:
    """Value of ``field`` at the last unmasked step, 0 when there is none."""
    value = F.element_at(sequence, -1).getField(field)
    return F.when(F.element_at(mask, -1) > 0, value).otherwise(F.lit(0.0))


def side_by_side_steps(a: Column, b: Column, a_fields: Sequence[str], b_fields: Sequence[str]) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        *[x.getField(f).alias(f) for f in a_fields], *[y.getField(f).alias(f) for f in b_fields]))


def joined_sequences(df: DataFrame, a: str, a_mask: str, b: str, b_mask: str,
                     a_fields: Sequence[str], b_fields: Sequence[str]) -> DataFrame:
    """Concatenate two sequences step by step; unequal masks fail the job."""
    same = F.assert_true(F.col(a_mask) == F.col(b_mask), F.lit("masks of the two sequences differ"))
    return df.filter(same.isNull()).withColumn(
        "sequence", side_by_side_steps(F.col(a), F.col(b), a_fields, b_fields))


def past_only_violations(df: DataFrame, history: str, sequence: str, mask: str) -> DataFrame:
    """Rows that break an invariant: history dated on or after the match, bad lengths or missing values."""
    return df.filter(breaks_invariant(history, sequence, mask))


def breaks_invariant(history: str, sequence: str, mask: str) -> Column:
    late = F.exists(history, lambda x: x.getField("_day") >= F.col(DAY))
    uneven = F.size(sequence) != F.size(mask)
    count = F.aggregate(mask, F.lit(0.0), lambda a, x: a + x)
    bad_count = (count < 0) | (count > F.size(mask)) | (count != F.size(history))
    missing = F.exists(sequence, lambda x: x.isNull())
    return late | uneven | bad_count | missing
