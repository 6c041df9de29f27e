"""Serve and return rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEAGUE_AVG_SERVE = 0.65
OPPONENT_COEFFICIENT = 0.10


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0.0 when the denominator is zero or anything is missing."""
    usable = F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.coalesce(numerator.cast("double") / usable, F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and infinities become 0.0."""
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(number)


def _stat(side: str, name: str) -> Column:
    return F.col(f"{side}_{name}")


def second_serve_points(side: str) -> Column:
    return _stat(side, "svpt") - _stat(side, "1stIn")


def serve_rates(side: str = "player") -> dict[str, Column]:
    """First-in, first-win, second-win, ace, double-fault and break-point-save rates."""
    return {
        f"{side}_1st_in_pct": safe_ratio(_stat(side, "1stIn"), _stat(side, "svpt")),
        f"{side}_1st_win_pct": safe_ratio(_stat(side, "1stWon"), _stat(side, "1stIn")),
        f"{side}_2nd_win_pct": safe_ratio(_stat(side, "2ndWon"), second_serve_points(side)),
        f"{side}_ace_rate": safe_ratio(_stat(side, "ace"), _stat(side, "svpt")),
        f"{side}_df_rate": safe_ratio(_stat(side, "df"), _stat(side, "svpt")),
        f"{side}_bp_save_pct": safe_ratio(_stat(side, "bpSaved"), _stat(side, "bpFaced")),
    }


def return_rates(side: str = "player", other: str = "opp") -> dict[str, Column]:
    """Return rates are one minus the other side's rate, hence 1.0 when that is undefined."""
    one = F.lit(1.0)
    return {
        f"{side}_1st_return_win_pct": one
        - safe_ratio(_stat(other, "1stWon"), _stat(other, "1stIn")),
        f"{side}_2nd_return_win_pct": one
        - safe_ratio(_stat(other, "2ndWon"), second_serve_points(other)),
        f"{side}_bp_convert_pct": one
        - safe_ratio(_stat(other, "bpSaved"), _stat(other, "bpFaced")),
    }


def serve_pct(side: str = "player") -> Column:
    """Share of service points won."""
    return safe_ratio(_stat(side, "1stWon") + _stat(side, "2ndWon"), _stat(side, "svpt"))


def return_pct(other: str = "opp") -> Column:
    """Share of the other side's service points won against it."""
    lost = _stat(other, "svpt") - _stat(other, "1stWon") - _stat(other, "2ndWon")
    return safe_ratio(lost, _stat(other, "svpt"))


def share_or_null(numerator: Column, denominator: Column) -> Column:
    """A ratio that stays unknown when the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def opponent_adjusted_serve(serve: Column, opponent_strength: Column) -> Column:
    """Serve share minus what a league-average server would win against this opponent."""
    expected = F.lit(LEAGUE_AVG_SERVE) - F.lit(OPPONENT_COEFFICIENT) * opponent_strength
    return serve - expected


def serve_skill(first: Column, second: Column, ace: Column, double_fault: Column) -> Column:
    zero = F.lit(0.0)
    return (
        F.lit(0.4) * F.coalesce(first, zero)
        + F.lit(0.4) * F.coalesce(second, zero)
        + F.lit(0.1) * F.coalesce(ace, zero)
        - F.lit(0.1) * F.coalesce(double_fault, zero)
    )


def return_skill(first: Column, second: Column) -> Column:
    zero = F.lit(0.0)
    return F.lit(0.5) * F.coalesce(first, zero) + F.lit(0.5) * F.coalesce(second, zero)
