"""Rank-free features. The steps are documented, their constants are not: those are parameters here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from courtlens.functions import decay, rates
from courtlens.operators import windows
from courtlens.operators.asof import asof_join
from courtlens.operators.timeline import global_position, history_columns

KEY, DAY, NUM = "player", "tourney_date", "match_num"
ORDER = (DAY, NUM)


@dataclass(frozen=True)
class Settings:
    baseline_rows: int = 10
    prior_rows: float = 5.0
    league_spw: float = 0.65
    league_rpw: float = 0.35
    spw_bounds: tuple[float, float] = (0.50, 0.80)
    rpw_bounds: tuple[float, float] = (0.25, 0.50)
    h2h_prior: float = 2.0
    h2h_cap: int = 10
    buckets: int = 8


DEFAULT = Settings()


def _clip(value: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(value, F.lit(bounds[0])), F.lit(bounds[1]))


def with_baselines(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Own past serve and return means, pulled towards the league mean, and the rows behind them."""
    base = df.withColumns({"spw": rates.serve_pct("player"), "rpw": rates.return_pct("opp")})

    def build(w):
        past = w.rowsBetween(-s.baseline_rows, -1)
        n = F.count(F.lit(1)).over(past)

        def shrunk(c, league):
            return (F.coalesce(F.sum(c).over(past), F.lit(0.0)) + s.prior_rows * league) / (n + s.prior_rows)

        return {"base_spw": shrunk("spw", s.league_spw), "base_rpw": shrunk("rpw", s.league_rpw),
                "player_matches_last10": F.count(F.lit(1)).over(w.rowsBetween(-10, -1))}

    return history_columns(base, [KEY], DAY, ORDER, max(10, s.baseline_rows), build)


def with_adjusted(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Serve and return shares corrected for the opponent's baseline and clipped."""
    faced = asof_join(df, df, left_key="opponent", right_key=KEY, day=DAY, number=NUM,
                      values=["base_spw", "base_rpw", "player_matches_last10"], prefix="o_")
    opp_rpw = F.coalesce("o_base_rpw", F.lit(s.league_rpw))
    opp_spw = F.coalesce("o_base_spw", F.lit(s.league_spw))
    out = faced.withColumns({
        "adj_spw": _clip(F.col("spw") - (opp_rpw - s.league_rpw), s.spw_bounds),
        "adj_rpw": _clip(F.col("rpw") - (opp_spw - s.league_spw), s.rpw_bounds),
        "opp_return_strength": opp_rpw,
        "opponent_matches_last10": F.coalesce("o_player_matches_last10", F.lit(0)),
    }).withColumn("net_skill", F.col("adj_spw") + F.col("adj_rpw") - 1)
    return out.drop("o_base_spw", "o_base_rpw", "o_player_matches_last10")


def with_recency(df: DataFrame) -> DataFrame:
    """Recency-weighted means of the previous 3 and 10 rows, and of the previous 10 on the surface."""
    def mean(w, c, n, fallback):
        past = F.collect_list(c).over(w.rowsBetween(-n, -1))
        return F.coalesce(decay.exponential_mean(past, decay.RECENCY_LAMBDA), F.lit(fallback))

    def overall(w):
        return {f"{c}_adj_last{n}": mean(w, f"adj_{c}", n, start)
                for c, start in (("spw", DEFAULT.league_spw), ("rpw", DEFAULT.league_rpw)) for n in (3, 10)}

    def on_surface(w):
        return {f"{c}_adj_last10_surface": mean(w, f"adj_{c}", 10, start)
                for c, start in (("spw", DEFAULT.league_spw), ("rpw", DEFAULT.league_rpw))}

    out = history_columns(df, [KEY], DAY, ORDER, 10, overall).withColumn("_surface", F.coalesce("surface", F.lit("")))
    return history_columns(out, [KEY, "_surface"], DAY, ORDER, 10, on_surface).drop("_surface")


def with_return_bucket(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Equal-sized bins 1..8 by recency-weighted return, as ``ntile`` gives, without one global sort."""
    placed = global_position(df, [F.col("rpw_adj_last10"), F.col(DAY), F.col(NUM), F.col(KEY)], "_position")
    total = df.agg(F.count(F.lit(1))).scalar()
    size, extra = F.floor(total / s.buckets), total % s.buckets
    wide = extra * (size + 1)
    bucket = F.when(F.col("_position") <= wide, F.floor((F.col("_position") - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((F.col("_position") - 1 - wide) / size) + 1)
    return placed.withColumn("rpw_bucket_8", bucket.cast("int")).drop("_position")


def with_pair_record(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Smoothed win share against this opponent and the capped number of earlier meetings."""
    met = windows.pair_before(df)
    share = (F.col("h2h_total_wins") + s.h2h_prior / 2) / (F.col("h2h_total_matches") + s.h2h_prior)
    return met.withColumns({
        "h2h_win_pct": share, "h2h_matches_capped": F.least(F.col("h2h_total_matches"), F.lit(s.h2h_cap)).cast("int")})


def with_interactions(df: DataFrame) -> DataFrame:
    """Edges between the player's and the opponent's recent form."""
    values = ["spw_adj_last10", "rpw_adj_last10", "rpw_bucket_8"]
    both = asof_join(df, df, left_key="opponent", right_key=KEY, day=DAY, number=NUM, values=values, prefix="o_")
    s10, r10 = F.col("spw_adj_last10"), F.col("rpw_adj_last10")
    os10 = F.coalesce("o_spw_adj_last10", F.lit(DEFAULT.league_spw))
    or10 = F.coalesce("o_rpw_adj_last10", F.lit(DEFAULT.league_rpw))
    out = both.withColumns({
        "player_serve_edge": s10 - or10, "opponent_serve_edge": os10 - r10,
        "player_form_edge": F.col("spw_adj_last3") - s10, "spw_diff_10": s10 - os10, "rpw_diff_10": r10 - or10,
        "bucket_diff": F.col("rpw_bucket_8") - F.coalesce("o_rpw_bucket_8", F.col("rpw_bucket_8")),
    })
    return out.withColumns({
        "bookmaker_net_edge": F.col("player_serve_edge") - F.col("opponent_serve_edge"),
        "interaction_product": F.col("player_serve_edge") * F.col("opponent_serve_edge"),
    }).drop(*[f"o_{v}" for v in values])


def bookmaker_features(df: DataFrame, s: Settings = DEFAULT, stage=lambda d: d) -> DataFrame:
    adjusted = stage(with_adjusted(with_baselines(df, s), s))
    recent = stage(with_return_bucket(with_recency(adjusted), s))
    return with_pair_record(with_interactions(recent), s)
