"""History windows: positions, careers, pair records, streaks and the report curves."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.functions import dates, decay
from courtlens.operators.timeline import before_each_day, history_columns, newest, with_day_state

DAY = "tourney_date"
NUM = "match_num"
ORDER = (DAY, NUM)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


# ---- unbounded state: everything before a row or a day ---------------------------------------


def career_position(df: DataFrame, keys: Sequence[str] = ("player",), name: str = "position") -> DataFrame:
    """1-based position of each row in its key's history."""
    inside = Window.partitionBy(*keys, DAY).orderBy(NUM)
    rows = df.withColumn("_inside", F.row_number().over(inside))
    state = before_each_day(
        df, keys, DAY, {"_n": F.count(F.lit(1))}, lambda w: {"_before": _zero(F.sum("_n").over(w))}
    )
    out = with_day_state(rows, state, keys, DAY)
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def career_before(df: DataFrame) -> DataFrame:
    """Matches, wins and win share of the player before this date."""
    state = before_each_day(
        df, ["player"], DAY,
        {"_n": F.count(F.lit(1)), "_w": F.sum("label")},
        lambda w: {
            "career_matches_prior": _zero(F.sum("_n").over(w)),
            "career_wins_prior": _zero(F.sum("_w").over(w)),
        },
    )
    share = F.col("career_wins_prior") / F.greatest(F.col("career_matches_prior"), F.lit(1))
    return with_day_state(df, state.withColumn("career_win_pct", share.cast("double")), ["player"], DAY)


def pair_before(df: DataFrame) -> DataFrame:
    """Record against this opponent before this date: matches, wins, wins in the last five, last result."""
    keys = ["player", "opponent"]
    back = Window.partitionBy(*keys, DAY).orderBy(F.col(NUM).desc())
    numbered = df.select(*keys, DAY, NUM, "label").withColumn("_back", F.row_number().over(back))
    last_five = F.collect_list(F.when(F.col("_back") <= 5, F.struct(NUM, "label")))
    days = numbered.groupBy(*keys, DAY).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_w"),
        F.transform(F.array_sort(last_five), lambda x: x.label).alias("_tail"),
    )
    earlier = Window.partitionBy(*keys).orderBy(DAY)
    all_before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    recent = decay.last_values(F.flatten(F.collect_list("_tail").over(earlier.rowsBetween(-5, -1))), 5)
    state = days.select(
        *keys, DAY, _zero(F.sum("_n").over(all_before)).alias("h2h_total_matches"),
        _zero(F.sum("_w").over(all_before)).alias("h2h_total_wins"), recent.alias("_recent"),
    ).withColumns({
        "h2h_recent_wins": F.aggregate("_recent", F.lit(0), lambda a, x: a + x),
        "h2h_last_result": F.when(F.size("_recent") > 0, F.element_at("_recent", -1)).otherwise(0),
    }).drop("_recent")
    return with_day_state(df, state, keys, DAY)


def streaks(df: DataFrame, keys: Sequence[str] = ("player",)) -> DataFrame:
    """Signed win/loss run before the row (``prior_streak``) and including it (``streak_after``).

    A run is the distance to the last opposite result, so only the latest position of a win and
    of a loss has to travel: within the day by a window, across days by a running maximum.
    """
    keys = list(keys)
    day = Window.partitionBy(*keys, DAY).orderBy(NUM)
    before_row = day.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.col("_i")
    rows = df.withColumn("_i", F.row_number().over(day))
    rows = rows.withColumns({
        "_win_today": F.max(F.when(F.col("label") == 1, inside)).over(before_row),
        "_loss_today": F.max(F.when(F.col("label") == 0, inside)).over(before_row),
    })
    days = rows.groupBy(*keys, DAY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("label") == 1, inside)).alias("_win"),
        F.max(F.when(F.col("label") == 0, inside)).alias("_loss"),
    )
    earlier = Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    started = days.withColumn("_start", _zero(F.sum("_n").over(earlier)))
    state = started.select(
        *keys, DAY, "_start",
        _zero(F.max(F.col("_start") + F.col("_win")).over(earlier)).alias("_win_before"),
        _zero(F.max(F.col("_start") + F.col("_loss")).over(earlier)).alias("_loss_before"),
    )
    start, played = F.col("_start"), F.col("_start") + inside - 1
    out = with_day_state(rows, state, keys, DAY).withColumns({
        "_last_win": F.coalesce(start + F.col("_win_today"), F.col("_win_before")),
        "_last_loss": F.coalesce(start + F.col("_loss_today"), F.col("_loss_before")),
        "_played": played,
    })
    prior = F.when(F.col("_played") == 0, 0).when(
        F.col("_last_win") > F.col("_last_loss"), F.col("_played") - F.col("_last_loss")
    ).otherwise(F.col("_last_win") - F.col("_played"))
    won = F.col("label") == 1
    after = F.when(won, F.col("_played") + 1 - F.col("_last_loss")).otherwise(
        F.col("_last_win") - F.col("_played") - 1
    )
    return out.select(
        *df.columns, prior.cast("bigint").alias("prior_streak"), after.cast("bigint").alias("streak_after")
    )


def first_run_streak(df: DataFrame) -> DataFrame:
    """The stored streak taken literally: the part of the career's opening run played before this date."""
    at = F.struct(DAY, NUM)
    opening = df.groupBy("player").agg(
        F.min(F.when(F.col("label") == 1, at)).alias("_first_win"),
        F.min(F.when(F.col("label") == 0, at)).alias("_first_loss"),
    ).select(
        "player",
        F.when(F.col("_first_loss").isNull() | (F.col("_first_win") < F.col("_first_loss")), 1)
        .otherwise(-1).alias("_sign"),
        F.when(F.col("_first_win").isNull() | F.col("_first_loss").isNull(), None)
        .otherwise(F.greatest("_first_win", "_first_loss")).alias("_turn"),
    )
    inside = df.join(opening, "player").withColumn(
        "_opening", F.when(F.col("_turn").isNull() | (at < F.col("_turn")), 1).otherwise(0)
    )
    state = before_each_day(
        inside, ["player"], DAY, {"_o": F.sum(F.col("_opening") * F.col("_sign"))},
        lambda w: {"stored_streak": _zero(F.sum("_o").over(w))},
    )
    return with_day_state(df, state, ["player"], DAY)


def cumulative_meetings(df: DataFrame) -> DataFrame:
    """Running wins of both players of a pair, meeting by meeting (``df``: one row per match)."""
    one = F.least("winner_name", "loser_name")
    two = F.greatest("winner_name", "loser_name")
    rows = df.withColumns({"player_one": one, "player_two": two}).withColumns({
        "_w1": (F.col("winner_name") == F.col("player_one")).cast("bigint"),
        "_w2": (F.col("winner_name") == F.col("player_two")).cast("bigint"),
    })
    keys = ["player_one", "player_two"]
    inside = Window.partitionBy(*keys, DAY).orderBy(NUM).rowsBetween(Window.unboundedPreceding, 0)
    state = before_each_day(
        rows, keys, DAY,
        {"_n": F.count(F.lit(1)), "_d1": F.sum("_w1"), "_d2": F.sum("_w2")},
        lambda w: {n: _zero(F.sum(c).over(w)) for n, c in (("_n0", "_n"), ("_b1", "_d1"), ("_b2", "_d2"))},
    )
    return with_day_state(rows, state, keys, DAY).withColumns({
        "meeting": F.col("_n0") + F.count(F.lit(1)).over(inside),
        "player_one_wins": F.col("_b1") + F.sum("_w1").over(inside),
        "player_two_wins": F.col("_b2") + F.sum("_w2").over(inside),
    }).drop("_n0", "_b1", "_b2", "_w1", "_w2")


# ---- frames of a fixed number of rows ----------------------------------------------------------


def days_since_previous(df: DataFrame, clip: bool = True) -> DataFrame:
    def build(w):
        day = dates.as_date(F.col(DAY))
        gap = F.coalesce(F.datediff(day, F.lag(day).over(w)), F.lit(0))
        value = F.greatest(F.least(gap, F.lit(365)), F.lit(0)) if clip else gap
        return {"days_since_prev": value.cast("double")}

    return history_columns(df, ["player"], DAY, ORDER, 1, build)


def rolling_including_current(df: DataFrame, stats: Sequence[str], windows: Sequence[int] = (3, 10, 25)) -> DataFrame:
    """Means in percent over the last rows up to and including this one; nulls are skipped."""

    def build(w):
        return {
            f"{s}_avg{n}": F.avg(s).over(w.rowsBetween(-(n - 1), 0)) * 100 for s in stats for n in windows
        }

    return history_columns(df, ["player"], DAY, ORDER, max(windows) - 1, build)


def volatility_and_form(df: DataFrame) -> DataFrame:
    """Ten-match volatility (null until ten matches) and the composite form rating."""

    def build(w):
        ten = w.rowsBetween(-9, 0)
        spread = F.stddev_pop(F.col("serve_pct") + F.col("return_pct")).over(ten)
        full = F.count(F.lit(1)).over(ten) >= 10
        rank = F.coalesce(F.nullif(F.col("opponent_rank"), F.lit(0.0)), F.lit(1000.0))
        quality = F.greatest(F.lit(0.0), (1000 - F.avg(rank).over(ten)) / 10)

        def positive(c):
            return F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))).over(ten), F.lit(0.0))

        play = (positive("serve_pct") + positive("return_pct")) / 2 * 100
        wins = F.avg(F.col("label").cast("double")).over(ten) * 100
        return {
            "volatility": F.when(full, F.least(F.lit(100.0), spread * 200)),
            "form_rating": F.least(F.lit(100.0), wins * 0.4 + quality * 0.3 + play * 0.3),
        }

    return history_columns(df, ["player"], DAY, ORDER, 9, build)


def momentum(df: DataFrame) -> DataFrame:
    def build(w):
        three = w.rowsBetween(-2, 0)
        wins = F.avg(F.col("label").cast("double")).over(three)
        play = (F.avg("serve_pct").over(three) + F.avg("return_pct").over(three)) / 2
        return {"momentum": wins * 50 + play * 50}

    return history_columns(df, ["player"], DAY, ORDER, 2, build)


# ---- the newest few rows of every player ----------------------------------------------------


def last_in_order(df: DataFrame, n: int) -> tuple[DataFrame, object]:
    """The newest ``n`` rows per player and a window over them, oldest first."""
    rows = newest(df, ["player"], ORDER, n)
    return rows, Window.partitionBy("player").orderBy(*ORDER)


def surface_form(df: DataFrame, surface: str, n: int = 15) -> DataFrame:
    """Rolling win share over 3 and 10 matches on one surface."""
    rows, w = last_in_order(df.filter(F.col("surface") == surface), n)
    won = F.col("label").cast("double")
    return rows.withColumns({
        f"win_pct{k}": F.avg(won).over(w.rowsBetween(-(k - 1), 0)) * 100 for k in (3, 10)
    })


def expanding_win_rate(df: DataFrame, n: int = 10) -> DataFrame:
    rows, w = last_in_order(df, n)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({
        "match_index": F.row_number().over(w),
        "win_rate": F.avg(F.col("label").cast("double")).over(so_far) * 100,
    })


def expected_and_actual(df: DataFrame, n: int = 25) -> DataFrame:
    """Mean of up to ten previous matches against the play of this one."""
    rows, w = last_in_order(df, n)
    before = w.rowsBetween(-10, -1)
    expected = (F.avg("serve_pct").over(before) + F.avg("return_pct").over(before)) / 2 * 100
    both = (F.col("serve_pct") != 0) & (F.col("return_pct") != 0)
    actual = F.when(both, (F.col("serve_pct") + F.col("return_pct")) / 2 * 100)
    out = rows.withColumns({"expected": expected, "actual": actual})
    return out.filter(F.col("expected").isNotNull() & F.col("actual").isNotNull()).withColumn(
        "difference", F.col("actual") - F.col("expected")
    )


def slopes(df: DataFrame, n: int = 10) -> DataFrame:
    """Least-squares slope of serve and return over the last three matches."""
    rows, w = last_in_order(df, n)
    three = w.rowsBetween(-2, 0)
    numbered = rows.withColumn("match_index", F.row_number().over(w))
    x = F.col("match_index").cast("double")
    enough = F.count(F.lit(1)).over(three) >= 2
    return numbered.withColumns({
        f"{side}_slope": F.when(enough, F.regr_slope(F.col(f"{side}_pct") * 100, x).over(three))
        for side in ("serve", "return")
    })


def weighted_and_plain(df: DataFrame, n: int = 10, half_life: float = decay.HALF_LIFE) -> DataFrame:
    """Half-life weighted mean next to the plain mean, growing over the last matches."""
    rows, w = last_in_order(df, n)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    speed = math.log(2.0) / half_life
    out = rows
    for side in ("serve", "return"):
        values = F.collect_list(F.col(f"{side}_pct") * 100).over(so_far)
        out = out.withColumns({
            f"{side}_weighted": decay.exponential_mean(values, speed),
            f"{side}_raw": F.avg(F.col(f"{side}_pct") * 100).over(so_far),
        })
    return out


def rest_days(df: DataFrame, n: int = 10) -> DataFrame:
    """Days of rest within the last matches and the three-match means (null for the first two)."""
    rows, w = last_in_order(df, n)
    day = dates.as_date(F.col(DAY))
    three = w.rowsBetween(-2, 0)
    index = F.row_number().over(w)
    return rows.withColumns({
        "match_index": index,
        "days_rest": F.coalesce(F.datediff(day, F.lag(day).over(w)), F.lit(0)),
        **{f"rolling_{s}": F.when(index >= 3, F.avg(f"{s}_pct").over(three)) for s in ("serve", "return")},
    })


def days_until(df: DataFrame, as_of: str, n: int = 6) -> DataFrame:
    """Days from each of the newest matches to a given date, never negative."""
    rows = newest(df, ["player"], ORDER, n)
    gap = F.datediff(F.to_date(F.lit(as_of)), dates.as_date(F.col(DAY)))
    return rows.withColumn("days", F.greatest(gap, F.lit(0)))


def last_year(df: DataFrame, as_of: str) -> DataFrame:
    """Rows since the month start twelve months before ``as_of``."""
    first = F.add_months(F.trunc(F.to_date(F.lit(as_of)), "month"), -12)
    return df.filter(dates.as_date(F.col(DAY)) >= first)


def monthly_rank(df: DataFrame, as_of: str) -> DataFrame:
    """Last known rank per month over twelve months, carried forward over empty months."""
    ranked = last_year(df, as_of).filter(F.col("player_rank").isNotNull())
    month = F.trunc(dates.as_date(F.col(DAY)), "month")
    latest = ranked.groupBy("player", month.alias("month")).agg(
        F.max_by("player_rank", F.struct(DAY, NUM)).alias("rank")
    )
    this_month = F.trunc(F.to_date(F.lit(as_of)), "month")
    calendar = df.select("player").distinct().select(
        "player",
        F.explode(F.sequence(F.add_months(this_month, -11), this_month, F.expr("interval 1 month"))).alias("month"),
    )
    w = Window.partitionBy("player").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    # a rank from the month before the calendar starts is not carried in
    return calendar.join(latest, ["player", "month"], "left").withColumn(
        "rank", F.last("rank", ignorenulls=True).over(w)
    )


def previous_year_mean(df: DataFrame, value: str, first: int = 730, last: int = 366) -> DataFrame:
    """Mean of ``value`` over the days 730..366 before the match day (``<value>_prev_year``)."""
    day_no = F.datediff(dates.as_date(F.col(DAY)), F.lit("1970-01-01").cast("date"))
    days = df.withColumn("_d", day_no).groupBy("player", DAY, "_d").agg(
        F.sum(value).alias("_s"), F.count(value).alias("_n")
    )
    w = Window.partitionBy("player").orderBy("_d").rangeBetween(-first, -last)
    state = days.select(
        "player", DAY, (F.sum("_s").over(w) / F.nullif(F.sum("_n").over(w), F.lit(0))).alias(f"{value}_prev_year")
    )
    return with_day_state(df, state, ["player"], DAY)
