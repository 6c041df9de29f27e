"""Category codes, event tiers and display names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Category orders; the position is the code, the last entry stands for unknown.
SURFACES = ("Hard", "Clay", "Grass", "Carpet", "Unknown")
LEVELS = ("C", "A", "250", "500", "M", "G", "F", "D", "Unknown")
ROUNDS = ("RR", "R128", "R96", "R64", "R48", "R32", "R16", "QF", "SF", "F", "BR", "Unknown")
ONE_HOT_SURFACES = ("Hard", "Clay", "Grass")
DRAW_ROUNDS = ("R128", "R64", "R32", "R16", "QF", "SF", "F")
LATE_ROUNDS = ("R32", "R16", "QF", "SF", "F")
NUMBERED_ROUNDS = ("R1", "R2", "R3", "R16", "QF", "SF", "F")
SLAMS = ("Australian Open", "French Open", "Wimbledon", "US Open")

# Display names of model features.
DISPLAY_NAMES = {
    "serve_skill": "Serve Skill (roll10)",
    "return_skill": "Return Skill (roll10)",
    "spw_diff": "SPW vs Expected",
    "rpw_diff": "RPW vs Expected",
    "serve_form_delta": "Serve Form (roll5 - roll30)",
    "return_form_delta": "Return Form (roll5 - roll30)",
    "opp_serve_skill": "Opponent Serve Skill",
    "opp_return_skill": "Opponent Return Skill",
    "days_since_last_match": "Days Since Last Match",
    "serve_vs_return_edge": "Serve vs Return Edge",
    "return_vs_serve_edge": "Return vs Serve Edge",
    "net_edge": "Net Edge",
    "player_style_cluster": "Player Style Cluster",
    "opp_style_cluster": "Opponent Style Cluster",
    "style_matchup": "Style Matchup",
    "serve_pct_weighted": "Recent Serve Performance",
    "return_pct_weighted": "Recent Return Performance",
    "win_flag": "Recent Win Rate",
    "opp_rank_norm_weighted": "Recent Opponent Strength",
    "opp_strength_weighted": "Recent Opponent Quality",
    "days_since_prev_weighted": "Match Frequency",
    "decay_weight": "Recency Weight",
    "surface_idx": "Surface Preference",
    "tourney_level_idx": "Tournament Level",
    "round_idx": "Round Importance",
    "raw_serve_pct": "Raw Serve %",
    "raw_return_pct": "Raw Return %",
    "raw_win_flag": "Raw Win Flag",
    "raw_serve_diff_prev_year": "Serve Trend vs Last Year",
    "raw_return_diff_prev_year": "Return Trend vs Last Year",
    "raw_player_rank": "Current Player Rank",
    "raw_opponent_rank": "Current Opponent Rank",
    "player_rank_norm": "Player Ranking Strength",
    "opponent_rank_norm": "Opponent Ranking Strength",
    "rank_diff": "Ranking Advantage",
    "career_matches_prior": "Career Experience",
    "career_win_pct": "Career Win Rate",
    "player_age": "Player Age",
    "opponent_age": "Opponent Age",
    "age_diff": "Age Advantage",
    "days_since_prev": "Days Since Last Match",
    "days_since_prev_log": "Match Frequency (Log)",
    "recent_weighted_serve": "Recent Serve Form",
    "recent_weighted_return": "Recent Return Form",
    "recent_weighted_opp_strength": "Recent Opponent Quality",
    "recent_weighted_win_pct": "Recent Win Rate",
    "serve_slope_last3": "Serve Form Trend",
    "return_slope_last3": "Return Form Trend",
    "expected_serve_pct": "Expected Serve Performance",
    "expected_return_pct": "Expected Return Performance",
    "expected_diff_serve": "Serve vs Expected",
    "expected_diff_return": "Return vs Expected",
    "h2h_total_matches": "Head-to-Head Matches",
    "h2h_total_wins": "Head-to-Head Wins",
    "h2h_recent_wins": "Recent H2H Performance",
    "h2h_last_result": "Last H2H Result",
    "streak": "Current Win Streak",
}

# Feature categories.
CATEGORIES = {
    "Serve/Return Form": (
        "serve_skill", "return_skill", "spw_diff", "rpw_diff", "serve_form_delta", "return_form_delta",
    ),
    "Opponent": ("opp_serve_skill", "opp_return_skill", "opp_style_cluster", "style_matchup"),
    "Matchup Edge": ("serve_vs_return_edge", "return_vs_serve_edge", "net_edge"),
    "Surface": ("surface_Hard", "surface_Clay", "surface_Grass"),
    "Style": ("player_style_cluster",),
    "Temporal": ("days_since_last_match",),
    "Recent Form": (
        "serve_pct_weighted", "return_pct_weighted", "win_flag", "recent_weighted_serve",
        "recent_weighted_return", "recent_weighted_win_pct", "serve_slope_last3", "return_slope_last3",
    ),
    "Opponent Strength": (
        "opp_rank_norm_weighted", "opp_strength_weighted", "opponent_rank_norm",
        "recent_weighted_opp_strength",
    ),
    "Match Context": ("surface_idx", "tourney_level_idx", "round_idx"),
    "Career & Ranking": (
        "career_matches_prior", "career_win_pct", "player_rank_norm", "rank_diff", "player_age",
        "opponent_age", "age_diff",
    ),
    "Head-to-Head": ("h2h_total_matches", "h2h_total_wins", "h2h_recent_wins", "h2h_last_result"),
    "Match Timing": (
        "days_since_prev_weighted", "days_since_prev", "days_since_prev_log", "match_frequency",
    ),
    "Performance vs Expected": (
        "expected_serve_pct", "expected_return_pct", "expected_diff_serve", "expected_diff_return",
    ),
}

# Features never shown among the top ones.
HIDDEN_FEATURES = (
    "days_since_prev_weighted", "days_since_prev", "days_since_prev_log", "decay_weight",
    "days_since_last_match",
)


def code_of(value: Column, order) -> Column:
    """Zero-based position in ``order``; unknown and missing values get the last position."""
    names = F.array(*[F.lit(name) for name in order])
    found = F.array_position(names, F.coalesce(value, F.lit(order[-1])))
    return F.when(found > 0, found - 1).otherwise(F.lit(len(order) - 1)).cast("int")


def one_hot_surfaces(surface: Column) -> dict[str, Column]:
    clean = F.trim(F.coalesce(surface, F.lit("")))
    return {f"surface_{name}": (clean == name).cast("double") for name in ONE_HOT_SURFACES}


def _has(name: Column, *parts: str) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | name.contains(part)
    return hit


def tier_from_event(name: Column) -> Column:
    """Tier code from the event name; events without a known word count as ``M``."""
    return (
        F.when(_has(name, "250"), "250")
        .when(_has(name, "500"), "500")
        .when(_has(name, "Masters"), "M")
        .when(_has(name, "Grand Slam", *SLAMS), "G")
        .otherwise("M")
    )


def tier_group(name: Column) -> Column:
    """Four-way tier of the win-rate report; null for other events."""
    return (
        F.when(_has(name, *SLAMS), "Grand Slam")
        .when(_has(name, "ATP250"), "ATP250")
        .when(_has(name, "ATP500"), "ATP500")
        .when(_has(name, "ATP1000"), "ATP1000")
    )


# Words that place an event, tried in this order.
LEVEL_WORDS = (
    ("C", ("Challenger",)),
    ("D", ("Davis Cup",)),
    ("A", ("ATP Cup", "United Cup")),
    ("F", ("Tour Finals", "ATP Finals", "Nitto ATP Finals")),
    ("G", ("Australian Open", "French Open", "Roland Garros", "Wimbledon", "US Open")),
    ("M", ("Miami", "Indian Wells", "Monte Carlo", "Madrid", "Rome", "Toronto", "Cincinnati",
           "Shanghai", "Paris Masters")),
    ("500", ("Dubai", "Barcelona", "Hamburg", "Washington", "Beijing", "Vienna", "Basel")),
)


def level_from_event(name: Column) -> Column:
    """Level code from place words; everything else is a 250 event."""
    level = F.lit("250")
    for code, words in reversed(LEVEL_WORDS):
        level = F.when(_has(name, *words), code).otherwise(level)
    return level


# Readable names of tier codes.
TIER_NAMES = {
    "250": "ATP 250", "500": "ATP 500", "M": "Masters 1000", "G": "Grand Slam", "F": "ATP Finals",
    "C": "Challenger", "A": "ATP Cup", "D": "Davis Cup",
}
LIST_GROUPS = {"G": "Grand Slam", "M": "ATP 1000", "500": "ATP 500/250", "250": "ATP 500/250",
               "A": "ATP 500/250"}


def lookup(value: Column, mapping: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[value], default)


def display_name(feature: Column) -> Column:
    return lookup(feature, DISPLAY_NAMES, F.initcap(F.replace(feature, F.lit("_"), F.lit(" "))))


def feature_category(feature: Column) -> Column:
    flat = {name: category for category, names in CATEGORIES.items() for name in names}
    return lookup(feature, flat, F.lit("Other"))
