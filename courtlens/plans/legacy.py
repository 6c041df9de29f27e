"""The earlier feature set: date-strict sequences with decayed serve form and static career features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from courtlens.functions import categories, rates, ranks
from courtlens.operators import sequences, windows
from courtlens.operators.orient import require_columns

NEEDED = ("player", "opponent", "match_id", "tourney_date", "label", "player_1stWon", "player_2ndWon",
          "player_svpt", "opp_1stWon", "opp_2ndWon", "opp_svpt", "surface", "tourney_level", "round")
STEP_INPUT = ("adj_serve", "opp_rank_norm", "surface_idx", "days_since_prev")
STATIC = ("player_rank_norm", "opponent_rank_norm", "rank_diff", "career_matches_prior", "days_since_prev",
          "days_since_prev_log", "recent_weighted_serve", "form_delta_serve")
RAW_STEP = ("raw_serve_pct", "raw_serve_diff_prev_year", "raw_player_rank_norm", "raw_opponent_rank_norm")


def with_step_inputs(df: DataFrame) -> DataFrame:
    """Per-match values a sequence step is made of."""
    require_columns(df, [*NEEDED, "opponent_rank"])
    base = df.withColumns({
        "serve_pct": rates.serve_pct("player"),
        "return_pct": rates.return_pct("opp"),
        "opp_rank_norm": ranks.rank_strength(F.col("opponent_rank")),
        "surface_idx": categories.code_of(F.col("surface"), categories.SURFACES),
        "tourney_level_idx": categories.code_of(F.col("tourney_level"), categories.LEVELS),
        "round_idx": categories.code_of(F.col("round"), categories.ROUNDS),
    })
    adjusted = base.withColumn(
        "adj_serve", rates.opponent_adjusted_serve(F.col("serve_pct"), F.col("opp_rank_norm")))
    return windows.days_since_previous(adjusted)


def with_sequences(df: DataFrame, n: int = sequences.SEQ_LEN) -> DataFrame:
    """``sequence`` and ``mask`` of the last matches on strictly earlier dates."""
    hist = sequences.strict_history(df, STEP_INPUT, n)
    return hist.withColumns({
        "sequence": sequences.left_padded(sequences.decayed_steps(F.col("history")), sequences.RANK_STEP, n),
        "mask": sequences.mask_of(F.size("history"), n),
    })


def with_static(df: DataFrame) -> DataFrame:
    """Rank, rest, career and last-step features."""
    out = windows.career_before(df).withColumns({
        "player_rank_norm": ranks.rank_strength(F.col("player_rank")),
        "opponent_rank_norm": ranks.rank_strength(F.col("opponent_rank")),
        "days_since_prev_log": F.log1p("days_since_prev"),
        "recent_weighted_serve": sequences.last_valid(F.col("sequence"), F.col("mask"), "adj_serve_medium_decay"),
        "form_delta_serve": sequences.last_valid(F.col("sequence"), F.col("mask"), "form_delta_serve"),
    })
    return out.withColumn("rank_diff", F.col("player_rank_norm") - F.col("opponent_rank_norm"))


def with_raw_sequences(df: DataFrame, n: int = sequences.SEQ_LEN) -> DataFrame:
    """Unweighted steps: serve share, its change against the year before, both rank strengths."""
    base = windows.previous_year_mean(df, "serve_pct").withColumns({
        "raw_serve_pct": F.least(F.greatest("serve_pct", F.lit(0.0)), F.lit(1.0)),
        "raw_player_rank_norm": ranks.rank_strength(F.col("player_rank")),
        "raw_opponent_rank_norm": ranks.rank_strength(F.col("opponent_rank")),
    }).withColumn(
        "raw_serve_diff_prev_year", F.coalesce(F.col("serve_pct") - F.col("serve_pct_prev_year"), F.lit(0.0)))
    hist = sequences.strict_history(base, RAW_STEP, n, "raw_history")
    plain = F.transform("raw_history", lambda x: F.struct(*[x.getField(f).alias(f) for f in RAW_STEP]))
    return hist.withColumns({
        "raw_sequence": sequences.left_padded(plain, RAW_STEP, n),
        "raw_mask": sequences.mask_of(F.size("raw_history"), n),
    })
