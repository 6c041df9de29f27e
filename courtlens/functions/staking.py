"""Stake rules and the registry that finds them by name.

A rule says how much of which base is staked. ``share`` is a fraction of the bankroll,
``amount`` a fixed sum; the stake is ``min(share * bankroll, amount, bankroll)`` with the
missing one left out. That split is what lets the ledger run without replaying bets one by one
where a rule is a pure share.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, functions as F

SHARE_CAP = 0.03


@dataclass(frozen=True)
class Stake:
    """``share``: fraction of the bankroll or None. ``amount``: fixed sum or None."""

    share: Column | None = None
    amount: Column | None = None

    def of(self, bankroll: Column) -> Column:
        parts = [bankroll]
        if self.share is not None:
            parts.append(self.share * bankroll)
        if self.amount is not None:
            parts.append(self.amount)
        return F.least(*parts) if len(parts) > 1 else parts[0]


def flat(prob: Column, odds: Column, *, stake_units: float = 1.0, **_) -> Stake:
    return Stake(amount=F.lit(float(stake_units)))


def kelly(prob: Column, odds: Column, *, fraction: float = 1.0, share_cap: float = SHARE_CAP,
          amount_cap: float | None = None, **_) -> Stake:
    """Kelly share times ``fraction``, never negative, at most ``share_cap`` of the bankroll."""
    raw = (prob * odds - 1) / (odds - 1) * F.lit(float(fraction))
    share = F.when(odds <= 1.0, F.lit(0.0)).otherwise(
        F.least(F.greatest(raw, F.lit(0.0)), F.lit(float(share_cap)))
    )
    return Stake(share=share, amount=None if amount_cap is None else F.lit(float(amount_cap)))


def _scaled(value: Column, start: float, width: float, max_stake: float) -> Column:
    scale = F.least((value - F.lit(start)) / F.lit(width), F.lit(1.0))
    return F.when(value < start, F.lit(0.0)).otherwise(F.lit(float(max_stake)) * scale)


def by_probability(prob: Column, odds: Column, *, prob_thr: float = 0.54, max_stake: float = 5.0, **_) -> Stake:
    return Stake(amount=_scaled(prob, prob_thr, 0.2, max_stake))


def by_odds(prob: Column, odds: Column, *, odds_thr: float = 1.30, max_stake: float = 5.0, **_) -> Stake:
    return Stake(amount=_scaled(odds, odds_thr, 1.0, max_stake))


def _kelly_of(fraction: float) -> Callable[..., Stake]:
    return lambda prob, odds, **options: kelly(prob, odds, **{**options, "fraction": fraction})


STRATEGIES: dict[str, Callable[..., Stake]] = {
    "flat": flat,
    "quarter_kelly": _kelly_of(0.25),
    "third_kelly": _kelly_of(0.33),
    "half_kelly": _kelly_of(0.5),
    "two_third_kelly": _kelly_of(0.66),
    "full_kelly": _kelly_of(1.0),
    "threshold_stake": by_probability,
    "odds_weighted_stake": by_odds,
}


def get_strategy(name: str) -> Callable[..., Stake]:
    if name not in STRATEGIES:
        raise ValueError(f"Unknown strategy: {name}. Available: {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def register_strategy(name: str, rule: Callable[..., Stake]) -> None:
    """Make a user's own rule available by name."""
    STRATEGIES[name] = rule


def edge(prob: Column, odds: Column) -> Column:
    return prob * odds - 1


def is_bet(prob: Column, odds: Column, *, min_prob: float = 0.54, min_odds: float = 1.30,
           min_edge: float = 0.0) -> Column:
    return (prob >= min_prob) & (odds >= min_odds) & (edge(prob, odds) >= min_edge)
