"""Stakes, bets and bankrolls (families A12, B20, C42-C44, D9, D14-D15, E27-E28, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.functions import dates, staking
from courtlens.operators import ledger
from courtlens.queries import views as _views  # noqa: F401  (registers the scored building block)
from courtlens.queries.base import cte, query, r6, rounded, sql_r6
from courtlens.queries.scoring import combined
from courtlens.operators.evaluate import as_predictions
from courtlens.sources import derived

TEMPERATURES = (1.0, 1.2, 1.4, 1.6, 1.8, 2.0)
PATH = ["season", "strategy", "temperature"]
ALL = list(staking.STRATEGIES)


def with_odds(spark, folder):
    preds = as_predictions(combined(spark, folder)).select("match_num", "tourney_date", "raw_probability", "prob_one", "prob_two", "actual")
    return ledger.oriented_odds(preds, derived.odds(spark, folder)).withColumn("season", dates.year_of(F.col("tourney_date")))


def bets(spark, folder, temperatures=(1.2,), odds=None):
    return ledger.chosen_bets(ledger.with_temperatures(with_odds(spark, folder) if odds is None else odds, temperatures))


cte("priced", ("scored",), """
SELECT match_num, tourney_date, CAST(tourney_date // 10000 AS INTEGER) AS season, raw_one, actual,
  CASE WHEN actual = 1 THEN 1.2 + (match_num % 40) / 40.0 ELSE 1.2 + ((match_num + 17) % 40) / 40.0 END::DOUBLE AS odds_one,
  CASE WHEN actual = 1 THEN 1.2 + ((match_num + 17) % 40) / 40.0 ELSE 1.2 + (match_num % 40) / 40.0 END::DOUBLE AS odds_two FROM scored
""")
cte("tempered", ("priced",), """
SELECT *, 1 / (1 + exp(-ln(greatest(least(raw_one, 1 - 1e-6), 1e-6) / (1 - greatest(least(raw_one, 1 - 1e-6), 1e-6))) / temperature)) AS p1
FROM priced CROSS JOIN (SELECT unnest([1.0, 1.2, 1.4, 1.6, 1.8, 2.0])::DOUBLE AS temperature)
""")
cte("bets", ("tempered",), """
SELECT match_num, tourney_date, season, temperature, CASE WHEN one THEN p1 ELSE 1 - p1 END AS prob, CASE WHEN one THEN odds_one ELSE odds_two END AS odds, (CASE WHEN one THEN actual = 1 ELSE actual = 0 END) AS won
FROM (SELECT *, p1 >= 0.54 AND odds_one >= 1.3 AND p1 * odds_one - 1 >= 0 AS one, 1 - p1 >= 0.54 AND odds_two >= 1.3 AND (1 - p1) * odds_two - 1 >= 0 AS two FROM tempered) WHERE one OR two
""")


def _kelly_sql(fraction: float, cap: float) -> str:
    return f"least(greatest((prob * odds - 1) / (odds - 1) * {fraction}, 0), {cap})"


_RULES_SQL = [
    ("flat", "NULL", "1.0"), ("quarter_kelly", _kelly_sql(0.25, 0.03), "NULL"), ("third_kelly", _kelly_sql(0.33, 0.03), "NULL"),
    ("half_kelly", _kelly_sql(0.5, 0.03), "NULL"), ("two_third_kelly", _kelly_sql(0.66, 0.03), "NULL"), ("full_kelly", _kelly_sql(1.0, 0.03), "NULL"),
    ("threshold_stake", "NULL", "CASE WHEN prob < 0.54 THEN 0 ELSE 5 * least((prob - 0.54) / 0.2, 1.0) END"),
    ("odds_weighted_stake", "NULL", "CASE WHEN odds < 1.3 THEN 0 ELSE 5 * least((odds - 1.3) / 1.0, 1.0) END"),
]
cte("staked", ("bets",), "\nUNION ALL\n".join(
    f"SELECT *, '{n}' AS strategy, CAST({s} AS DOUBLE) AS share, CAST({a} AS DOUBLE) AS amount FROM bets" for n, s, a in _RULES_SQL))
cte("placed", ("staked",), """
SELECT *, row_number() OVER (PARTITION BY season, strategy, temperature ORDER BY tourney_date, match_num) AS bet_number FROM staked WHERE temperature = 1.2
""")
cte("paths", ("placed",), """
SELECT season, strategy, temperature, CAST(0 AS BIGINT) AS bet_number, CAST(100.0 AS DOUBLE) AS bankroll, CAST(0.0 AS DOUBLE) AS stake FROM (SELECT DISTINCT season, strategy, temperature FROM placed)
UNION ALL
SELECT season, strategy, temperature, bet_number, b + CASE WHEN won THEN odds - 1 ELSE -1 END * stake, stake FROM (
  SELECT p.season, p.strategy, p.temperature, q.bet_number, p.bankroll AS b, q.won, q.odds,
    least(coalesce(q.share, 1.0) * p.bankroll, coalesce(q.amount, 1e300), p.bankroll) AS stake
  FROM paths p JOIN placed q ON q.season = p.season AND q.strategy = p.strategy AND q.temperature = p.temperature AND q.bet_number = p.bet_number + 1)
""")


@query("c42_stakes_c43_registry", "bets", " UNION ALL ".join(
    f"SELECT match_num, '{n}' AS strategy, round(least(coalesce(CAST({s} AS DOUBLE), 1.0) * 80.0, coalesce(CAST({a} AS DOUBLE), 80.0), 80.0), 6) + 0.0 AS stake FROM bets WHERE temperature = 1.2"
    for n, s, a in _RULES_SQL))
def _(spark, folder):
    df = bets(spark, folder)
    bankroll = F.lit(80.0)
    cells = [F.struct(F.lit(n).alias("strategy"), staking.get_strategy(n)(F.col("prob"), F.col("odds")).of(bankroll).alias("stake")) for n in ALL]
    return rounded(df.select("match_num", F.inline(F.array(*cells))), ["match_num", "strategy"], ["stake"])


@query("c44_selected_bets_d09_odds_join", "bets", "SELECT match_num, round(prob, 6) + 0.0 AS prob, round(odds, 6) + 0.0 AS odds, round(prob * odds - 1, 6) + 0.0 AS edge, won FROM bets WHERE temperature = 1.2")
def _(spark, folder):
    return rounded(bets(spark, folder), ["match_num", "won"], ["prob", "odds", "edge"])


@query("d14_temperature_candidates", "tempered", "SELECT match_num, temperature, round(p1, 6) + 0.0 AS prob_one FROM tempered")
def _(spark, folder):
    return rounded(ledger.with_temperatures(with_odds(spark, folder), TEMPERATURES), ["match_num", "temperature"], ["prob_one"])


def path(spark, folder, block=ledger.BLOCK, odds=None):
    numbered = ledger.numbered_bets(bets(spark, folder, odds=odds), ["season", "temperature"])
    staked = ledger.with_strategies(numbered, ALL)
    return ledger.bankroll_path(staked, PATH, block=block)


@query("k01_bankroll_paths", "paths", "SELECT season, strategy, temperature, bet_number, round(stake, 6) + 0.0 AS stake, round(bankroll, 6) + 0.0 AS bankroll FROM paths WHERE bet_number > 0")
def _(spark, folder):
    return rounded(path(spark, folder), [*PATH, "bet_number"], ["stake", "bankroll"])


@query("k02_equity_curves", "paths", "SELECT season, strategy, temperature, bet_number, round(bankroll, 6) + 0.0 AS bankroll FROM paths")
def _(spark, folder):
    return rounded(ledger.equity_curve(path(spark, folder), PATH), [*PATH, "bet_number"], ["bankroll"])


@query("k03_drawdown", "paths", """
SELECT season, strategy, temperature, round(max(peak - bankroll), 6) + 0.0 AS max_drawdown FROM (
  SELECT *, max(bankroll) OVER (PARTITION BY season, strategy, temperature ORDER BY bet_number) AS peak FROM paths) GROUP BY 1, 2, 3
""")
def _(spark, folder):
    return rounded(ledger.drawdown(path(spark, folder), PATH), PATH, ["max_drawdown"])


_SUMMARY = ["win_rate", "final_bankroll", "total_profit", "roi_pct", "max_drawdown", "risk_adjusted_roi", "pct_bet_on"]
cte("summaries", ("paths", "placed", "priced"), """
SELECT season, strategy, count(*) AS num_bets_placed, count(*) FILTER (WHERE won) AS bets_won, count(*) FILTER (WHERE NOT won) AS bets_lost, avg(CAST(won AS DOUBLE)) AS win_rate,
  arg_max(bankroll, bet_number) AS final_bankroll, arg_max(bankroll, bet_number) - 100 AS total_profit, arg_max(bankroll, bet_number) - 100 AS roi_pct, max(dd) AS max_drawdown,
  CASE WHEN max(dd) > 0 THEN (arg_max(bankroll, bet_number) - 100) / max(dd) ELSE 0 END AS risk_adjusted_roi, CAST(count(*) AS DOUBLE) / max(total) * 100 AS pct_bet_on, max(total) AS num_total_matches
FROM (SELECT season, strategy, bet_number, bankroll, greatest(max(bankroll) OVER (PARTITION BY season, strategy ORDER BY bet_number), 100.0) - bankroll AS dd FROM paths WHERE bet_number > 0) x
JOIN (SELECT season, strategy, bet_number, won FROM placed) w USING (season, strategy, bet_number) JOIN (SELECT season, count(*) AS total FROM priced GROUP BY 1) t USING (season) GROUP BY 1, 2
""")


def summaries(spark, folder, paths=None, odds=None):
    """``paths`` and ``odds`` are stored tables, if given."""
    totals = (with_odds(spark, folder) if odds is None else odds).groupBy("season").agg(F.count(F.lit(1)).alias("num_total_matches"))
    if paths is None:
        return ledger.summary(path(spark, folder), PATH, totals, ["season"])
    return ledger.summary(paths, PATH, totals, ["season"], stage=lambda d: d)


@query("e27_backtest_summary", "summaries", f"SELECT season, strategy, num_bets_placed, bets_won, bets_lost, num_total_matches, {sql_r6(*_SUMMARY)} FROM summaries")
def _(spark, folder):
    return rounded(summaries(spark, folder), ["season", "strategy", "num_bets_placed", "bets_won", "bets_lost", "num_total_matches"], _SUMMARY)


@query("b20_allowed_strategies_a12_d15", "summaries", "SELECT season, strategy, num_bets_placed FROM summaries WHERE strategy IN ('half_kelly', 'quarter_kelly', 'flat')")
def _(spark, folder):
    return ledger.shown_strategies(summaries(spark, folder), ["half_kelly", "quarter_kelly", "flat"]).select("season", "strategy", "num_bets_placed")


@query("b20_fallback_to_all", "summaries", "SELECT season, strategy, num_bets_placed FROM summaries")
def _(spark, folder):
    return ledger.shown_strategies(summaries(spark, folder), ["none_of_these"]).select("season", "strategy", "num_bets_placed")


cte("temperature_placed", ("bets",), f"""
SELECT *, {_kelly_sql(0.25, 0.02)} AS share, row_number() OVER (PARTITION BY season, temperature ORDER BY tourney_date, match_num) AS bet_number FROM bets
""")
cte("temperature_paths", ("temperature_placed",), """
SELECT season, temperature, CAST(0 AS BIGINT) AS bet_number, CAST(100.0 AS DOUBLE) AS bankroll FROM (SELECT DISTINCT season, temperature FROM temperature_placed)
UNION ALL
SELECT p.season, p.temperature, q.bet_number, p.bankroll + CASE WHEN q.won THEN q.odds - 1 ELSE -1 END * least(q.share * p.bankroll, 100.0, p.bankroll)
FROM temperature_paths p JOIN temperature_placed q ON q.season = p.season AND q.temperature = p.temperature AND q.bet_number = p.bet_number + 1
""")
cte("temperature_table", ("temperature_paths", "temperature_placed", "tempered"), """
SELECT c.season, c.temperature, coalesce(bets, 0) AS bets, coalesce(profit, 0) AS profit, coalesce(profit, 0) AS roi, coalesce(hit_rate, 0) AS hit_rate, coalesce(avg_edge, 0) AS avg_edge, coalesce(dd, 0) AS max_drawdown
FROM (SELECT DISTINCT season, temperature FROM tempered) c
LEFT JOIN (SELECT season, temperature, count(*) AS bets, avg(CAST(won AS DOUBLE)) AS hit_rate, avg(prob * odds - 1) AS avg_edge FROM temperature_placed GROUP BY 1, 2) a USING (season, temperature)
LEFT JOIN (SELECT season, temperature, arg_max(bankroll, bet_number) - 100 AS profit, max(peak - bankroll) AS dd FROM (
  SELECT *, max(bankroll) OVER (PARTITION BY season, temperature ORDER BY bet_number) AS peak FROM temperature_paths) GROUP BY 1, 2) b USING (season, temperature)
""")
_TEMP = ["profit", "roi", "hit_rate", "avg_edge", "max_drawdown"]


def temperature_table(spark, folder, odds=None):
    keys = ["season", "temperature"]
    candidates = ledger.with_temperatures(with_odds(spark, folder) if odds is None else odds, TEMPERATURES)
    staked = ledger.with_strategies(ledger.chosen_bets(candidates), ["quarter_kelly"], share_cap=0.02, amount_cap=100.0)
    return ledger.temperature_table(candidates, ledger.bankroll_path(staked, keys), keys)


@query("e28_temperature_comparison", "temperature_table", f"SELECT season, temperature, bets, {sql_r6(*_TEMP)} FROM temperature_table")
def _(spark, folder):
    return rounded(temperature_table(spark, folder), ["season", "temperature", "bets"], _TEMP)


@query("e28_best_temperature", "temperature_table", """
SELECT season, temperature, round(roi, 6) + 0.0 AS roi, bets FROM temperature_table QUALIFY row_number() OVER (PARTITION BY season ORDER BY round(roi, 9) DESC, temperature) = 1
""")
def _(spark, folder):
    best = ledger.best_temperature(temperature_table(spark, folder).withColumn("roi", F.round("roi", 9)), ["season"])
    return rounded(best, ["season", "temperature", "bets"], ["roi"])
