"""The feature plan: rates, rolling form, opponent skills, matchup edges and sequences.

Each step takes and returns a DataFrame and can be chained with ``df.transform``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from courtlens.functions import dates, rates
from courtlens.functions.categories import one_hot_surfaces
from courtlens.operators.asof import asof_join
from courtlens.operators.timeline import history_columns, longer_sums, rows_before

KEY = ("player",)
DAY = "tourney_date"
ORDER = ("tourney_date", "match_num")
SEQ_LEN = 10
WINDOWS = (3, 5, 10, 30)
ROLLED = (
    "player_1st_win_pct", "player_2nd_win_pct", "player_1st_return_win_pct",
    "player_2nd_return_win_pct", "player_ace_rate", "player_df_rate",
)
# Order of the features in a sequence step and in the static vector.
SEQUENCE_FEATURES = (
    "serve_skill", "return_skill", "spw_diff", "rpw_diff", "serve_form_delta", "return_form_delta",
    "surface_Hard", "surface_Clay", "surface_Grass", "days_since_last_match", "opp_serve_skill",
    "opp_return_skill",
)
STATIC_FEATURES = (
    "serve_vs_return_edge", "return_vs_serve_edge", "net_edge", "surface_Hard", "surface_Clay",
    "surface_Grass", "player_style_cluster", "opp_style_cluster", "style_matchup",
)


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({**rates.serve_rates(), **rates.return_rates()})


def with_rolled_rates(df: DataFrame) -> DataFrame:
    """The six rates that histories are made of."""
    return df.withColumns({n: c for n, c in {**rates.serve_rates(), **rates.return_rates()}.items() if n in ROLLED})


def with_rolling(df: DataFrame, windows=WINDOWS, rows_per_run: int | None = None, derive=None) -> DataFrame:
    """Past-only rolling means and the days since the previous match, in one window pass. ``derive``
    may add the rates after the rows are dealt by player."""
    seen = df if derive is None else derive(df)
    whole = not any(seen.schema[rate].nullable for rate in ROLLED)  # a missing rate is left out of the mean

    def build(w):
        gap = F.datediff(dates.as_date(F.col(DAY)), F.lag(dates.as_date(F.col(DAY))).over(w))
        days = {"days_since_last_match": F.greatest(
            F.least(F.coalesce(gap, F.lit(0)), F.lit(365)), F.lit(0)
        ).cast("double")}
        if not whole:
            return {**{f"{rate}_roll{n}": F.avg(rate).over(w.rowsBetween(-n, -1)) for n in windows for rate in ROLLED}, **days}
        unit = {n: 10 if n > 10 and n % 10 == 0 else n for n in windows}
        rows = {f"_rows{n}": rows_before(w, n) for n in windows}
        sums = {f"_{rate}_{n}": F.sum(rate).over(w.rowsBetween(-n, -1)) for n in set(unit.values()) for rate in ROLLED}
        longer = {}
        for n in windows:
            if unit[n] != n:
                longer |= longer_sums(w, {f"_{rate}_{n}": f"_{rate}_{unit[n]}" for rate in ROLLED}, n, unit[n])
        means = {f"{rate}_roll{n}": F.col(f"_{rate}_{n}") / F.col(f"_rows{n}") for n in windows for rate in ROLLED}
        return [rows | sums | days, longer, means]

    rolled = history_columns(df, KEY, DAY, ORDER, max(windows), build, rows_per_run, derive)
    return rolled.select(*seen.columns, *[f"{rate}_roll{n}" for n in windows for rate in ROLLED], "days_since_last_match")


def _skills(window: int):
    def c(name):
        return F.col(f"{name}_roll{window}")

    serve = rates.serve_skill(
        c("player_1st_win_pct"), c("player_2nd_win_pct"), c("player_ace_rate"), c("player_df_rate")
    )
    ret = rates.return_skill(c("player_1st_return_win_pct"), c("player_2nd_return_win_pct"))
    return serve, ret


def with_skills(df: DataFrame) -> DataFrame:
    serve, ret = _skills(10)
    return df.withColumns({"serve_skill": serve, "return_skill": ret})


def with_form(df: DataFrame) -> DataFrame:
    serve5, ret5 = _skills(5)
    serve30, ret30 = _skills(30)
    return df.withColumns({"serve_form_delta": serve5 - serve30, "return_form_delta": ret5 - ret30})


def with_opponent_skills(df: DataFrame, mode: str = "upto", more: Sequence[str] = ()) -> DataFrame:
    """The opponent's skills as of the match, and as ``opp_<name>`` whatever else is asked for."""
    joined = asof_join(
        df, df, left_key="opponent", right_key="player", day=DAY, number="match_num",
        values=["serve_skill", "return_skill", *more], prefix="opp_", mode=mode,
    )
    return joined.withColumns({
        name: F.coalesce(name, F.lit(0.0)) for name in ("opp_serve_skill", "opp_return_skill")
    })


def with_expectation(df: DataFrame) -> DataFrame:
    won = F.col("player_1stWon") + F.col("player_2ndWon")
    conceded = F.col("opp_1stWon") + F.col("opp_2ndWon")
    out = df.withColumns({
        "expected_spw": F.col("serve_skill") - F.col("opp_return_skill"),
        "actual_spw": rates.safe_ratio(won, F.col("player_svpt")),
        "expected_rpw": F.col("return_skill") - F.col("opp_serve_skill"),
        "actual_rpw": F.lit(1.0) - rates.safe_ratio(conceded, F.col("opp_svpt")),
    })
    return out.withColumns({
        "spw_diff": F.col("actual_spw") - F.col("expected_spw"),
        "rpw_diff": F.col("actual_rpw") - F.col("expected_rpw"),
    })


def with_edges(df: DataFrame) -> DataFrame:
    out = df.withColumns({
        "serve_vs_return_edge": F.col("serve_skill") - F.col("opp_return_skill"),
        "return_vs_serve_edge": F.col("return_skill") - F.col("opp_serve_skill"),
    })
    return out.withColumn("net_edge", F.col("serve_vs_return_edge") + F.col("return_vs_serve_edge"))


def with_surface(df: DataFrame) -> DataFrame:
    return df.withColumns(one_hot_surfaces(F.col("surface")))


def with_surface_skills(df: DataFrame, rows_per_run: int | None = None) -> DataFrame:
    """Mean skill of the previous ten matches on the same surface; 0 on other surfaces."""
    tagged = df.withColumn("_surface", F.trim(F.coalesce("surface", F.lit(""))))

    def build(w):
        known = F.col("_surface").isin("Hard", "Clay", "Grass")
        frame = w.rowsBetween(-10, -1)
        return {
            f"surface_{s}": F.when(known, F.coalesce(F.avg(s).over(frame), F.lit(0.0))).otherwise(0.0)
            for s in ("serve_skill", "return_skill")
        }

    return history_columns(tagged, ("player", "_surface"), DAY, ORDER, 10, build, rows_per_run).drop("_surface")


def match_features(df: DataFrame, mode: str = "upto", rows_per_run: int | None = None,
                   stage=lambda d: d) -> DataFrame:
    """Everything up to the matchup edges. ``stage`` may materialise the rolling step."""
    staged = stage(own_features(df, rows_per_run, with_rates))
    return faced_features(staged.transform(lambda d: with_opponent_skills(d, mode)))


def own_features(df: DataFrame, rows_per_run: int | None = None, derive=with_rolled_rates) -> DataFrame:
    """Rolling form and skills from the player's own rows, where no opponent is needed."""
    rolled = with_rolling(df, rows_per_run=rows_per_run, derive=derive).transform(with_skills).transform(with_form)
    return rolled.drop(*[f"{r}_roll{w}" for r in ROLLED for w in WINDOWS if w != 30])


def faced_features(df: DataFrame) -> DataFrame:
    """What follows row by row once the opponent's skills are known."""
    return df.transform(with_expectation).transform(with_edges).transform(with_surface)
