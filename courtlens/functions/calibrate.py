"""Probability calibration and the texts shown with a prediction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-6
AS_AT_TEMPERATURE = 1.2


def _clip(p: Column, eps: float) -> Column:
    return F.greatest(F.least(p.cast("double"), F.lit(1.0 - eps)), F.lit(eps))


def to_logit(p: Column) -> Column:
    clipped = _clip(p, EPS)
    return F.ln(clipped / (F.lit(1.0) - clipped))


def to_probability(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def with_temperature(p: Column, temperature: Column) -> Column:
    return to_probability(to_logit(p) / temperature)


def with_platt(p: Column, a: Column, b: Column) -> Column:
    return to_probability(a * to_logit(p) + b)


def calibrated(p: Column, method: Column, temperature: Column, a: Column, b: Column,
               override: Column | None = None) -> Column:
    """Calibrate by method name; no method leaves ``p`` alone, an override temperature wins."""
    one = F.lit(1.0)
    chosen = (
        F.when(method == "temperature", with_temperature(p, F.coalesce(temperature, one)))
        .when(method == "platt", with_platt(p, F.coalesce(a, one), F.coalesce(b, F.lit(0.0))))
        .otherwise(p)
    )
    if override is None:
        return chosen
    return F.when(method.isNotNull() & override.isNotNull(), with_temperature(p, override)).otherwise(chosen)


def negative_log_likelihood(p: Column, actual: Column, eps: float = EPS) -> Column:
    clipped = _clip(p, eps)
    y = actual.cast("double")
    return -(y * F.ln(clipped) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - clipped))


def squared_error(p: Column, actual: Column) -> Column:
    gap = p - actual.cast("double")
    return gap * gap


def decimal_odds(p: Column) -> Column:
    return F.round(F.lit(1.0) / F.greatest(p, F.lit(EPS)), 3)


def expected_margin(confidence: Column) -> Column:
    """Games of margin, piecewise linear in the confidence."""
    c = confidence
    margin = F.when(c >= 0.90, F.lit(6.0))
    for low, base in ((0.80, 5.0), (0.70, 4.0), (0.60, 3.0), (0.55, 2.5), (0.50, 2.0)):
        margin = margin.when(c >= low, F.lit(base) + (c - F.lit(low)) * F.lit(10.0))
    return margin.otherwise(F.lit(0.0))


# Lower bounds of the score words.
SCORE_WORDS = ((0.95, "bagel"), (0.90, "smashing"), (0.80, "dominant"), (0.65, "likely"), (0.55, "close"))


def score_word(confidence: Column) -> Column:
    (bound, word), *rest = SCORE_WORDS
    label = F.when(confidence >= bound, word)
    for bound, word in rest:
        label = label.when(confidence >= bound, word)
    return label.otherwise("toss-up")


def betting_advice(confidence: Column) -> Column:
    return (
        F.when(confidence < 0.58, "Probably a bad bet")
        .when(confidence >= 0.70, "Maybe a good bet")
        .otherwise("Proceed with caution")
    )
