import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlens.operators import evaluate, ledger
from courtlens.plans import scoring


def test_auc_against_pairs(spark):
    rnd = random.Random(5)
    data = [(rnd.randrange(2), round(rnd.random(), 1) if rnd.random() < 0.5 else rnd.random(), rnd.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(data, "g int, prob_one double, actual int")
    for r in evaluate.auc_by(df, ["g"]).collect():
        pos = [p for g, p, y in data if g == r.g and y]
        neg = [p for g, p, y in data if g == r.g and not y]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert r.auc == pytest.approx(want)
    single = spark.createDataFrame([(1, 0.3, 1)], "g int, prob_one double, actual int")
    assert math.isnan(evaluate.auc_by(single, ["g"]).first().auc)


def test_perspectives_must_mirror(spark):
    rows = [("m1", 1, 20200101, "A B", "C D", 1, 0.8), ("m1", 1, 20200101, "C D", "A B", 0, 0.4),
            ("m2", 2, 20200101, "A B", "C D", 1, 0.8), ("m2", 2, 20200101, "A B", "C D", 0, 0.4), ("m3", 3, 20200101, "A B", "C D", 1, 0.5)]
    df = spark.createDataFrame(rows, "match_id string, match_num long, tourney_date int, player string, opponent string, label int, prob double")
    out = evaluate.combine_perspectives(df).collect()
    assert [r.match_id for r in out] == ["m1"]
    assert out[0].raw_probability == pytest.approx(0.7) and out[0].actual == 1 and out[0].player_one == "A B"


def _bets(n=500, seed=1):
    rnd = random.Random(seed)
    rules = {"share": lambda: (0.3 * rnd.random(), None), "fixed": lambda: (None, 9.0), "both": lambda: (0.25, 40.0), "mixed": lambda: (None, 30 * rnd.random())}
    rows = []
    for name, rule in rules.items():
        for i in range(n):
            share, amount = rule()
            rows.append((name, 20200101 + rnd.randrange(28), i, share, amount, 1.3 + rnd.random() * 1.6, rnd.random() < 0.5, 0.1))
    return rows


@pytest.mark.parametrize("block", [3, 17, 2000])
def test_bankroll_paths_against_replay(spark, block):
    rows = _bets()
    df = spark.createDataFrame(rows, "strategy string, tourney_date int, match_num long, share double, amount double, odds double, won boolean, edge double")
    path = ledger.bankroll_path(df, ["strategy"], block=block)
    got = {(r.strategy, r.bet_number): r.bankroll for r in path.collect()}
    drawdowns = {r.strategy: r.max_drawdown for r in ledger.drawdown(path, ["strategy"]).collect()}
    for name in ("share", "fixed", "both", "mixed"):
        bank, peak, worst = 100.0, 100.0, 0.0
        for k, (_, _, _, share, amount, odds, won, _) in enumerate(sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2])), 1):
            stake = min((1.0 if share is None else share) * bank, math.inf if amount is None else amount, bank)
            bank += stake * (odds - 1 if won else -1)
            peak, worst = max(peak, bank), max(worst, max(peak, bank) - bank)
            assert got[(name, k)] == pytest.approx(bank, rel=1e-7, abs=1e-7)
        assert drawdowns[name] == pytest.approx(worst, rel=1e-7, abs=1e-7)
    assert len(got) == len(rows)


def test_broken_lines_compose():
    rnd = random.Random(4)
    for _ in range(60):
        share, amount, gain = (np.array([rnd.choice(c) for _ in range(12)]) for c in (
            (0.0, 0.1, 0.5, 1.0), (math.inf, 1.0, 20.0, 0.0), (-1.0, -1.0, 0.8, 2.0)))
        first, second = ledger.line_of_bets(share[:5], amount[:5], gain[:5]), ledger.line_of_bets(share[5:], amount[5:], gain[5:])
        whole = ledger.BrokenLine.unpack(first.then(second).pack())
        assert len(whole.until) <= 13 and list(whole.until) == sorted(set(whole.until.tolist()))
        for x in [0.0, 0.5, 1.0, 20.0, 40.0, 1e6, *[rnd.random() * 100 for _ in range(10)]]:
            bank = x
            for s, m, g in zip(share, amount, gain):
                bank += g * min(s * bank, m)
            assert whole(x) == pytest.approx(bank, rel=1e-9, abs=1e-9)
            assert second(first(x)) == pytest.approx(bank, rel=1e-9, abs=1e-9)


def test_number_of_jobs_does_not_follow_the_path(spark):
    schema = "strategy string, tourney_date int, match_num long, share double, amount double, odds double, won boolean, edge double"

    def jobs(n, tag):
        # every block ends close to where its bets change side
        rows = [("a", 20200101, i, 0.5, 50.0, 2.0, i % 2 == 0, 0.1) for i in range(n)]
        spark.sparkContext.setJobGroup(tag, tag)
        ledger.bankroll_path(spark.createDataFrame(rows, schema), ["strategy"], block=7).count()
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
        spark.sparkContext.setJobGroup("", "")
        return found

    assert jobs(60, "short path") + 2 >= jobs(2000, "long path")


def test_drawdown_is_in_currency(spark):
    # stored equity curve: peak 112.98980, trough 108.51540
    values = [102.08, 106.244864, 104.11996672, 112.98979914982364, 110.73000316682716, 108.51540310349064, 111.70575595473323]
    df = spark.createDataFrame([("a", i + 1, 0, v) for i, v in enumerate(values)], "strategy string, bet_number long, _block long, bankroll double")
    assert ledger.drawdown(df, ["strategy"]).first().max_drawdown == pytest.approx(4.474396046333027)


def test_summary_of_a_path(spark):
    # published: 227 of 828 matches, ROI 123.187 at drawdown 23.494
    values = [100.0 + k * 0.5 for k in range(225)] + [246.681033200998, 223.186993682975]
    rows = [("a", k + 1, 0, v, k % 3 > 0, 0.1) for k, v in enumerate(values)]
    path = spark.createDataFrame(rows, "strategy string, bet_number long, _block long, bankroll double, won boolean, edge double")
    totals = spark.createDataFrame([("a", 828)], "strategy string, num_total_matches long")
    r = ledger.summary(path, ["strategy"], totals, ["strategy"]).first()
    assert (r.num_bets_placed, r.bets_won, r.bets_lost) == (227, 151, 76)
    assert r.roi_pct == pytest.approx(123.186993682975) and r.max_drawdown == pytest.approx(23.494039518023)
    assert r.risk_adjusted_roi == pytest.approx(5.243329413192255)
    assert r.pct_bet_on == pytest.approx(27.415458937198068)


def test_confusion_matches_published_ratios(spark):
    rows = [(0.9, 1)] * 1281 + [(0.1, 0)] * 1034 + [(0.9, 0)] * 337 + [(0.1, 1)] * 159
    r = evaluate.confusion(spark.createDataFrame(rows, "prob_one double, actual int")).first()
    assert (r.true_positive, r.true_negative, r.false_positive, r.false_negative) == (1281, 1034, 337, 159)
    assert r.accuracy == pytest.approx(0.82355, abs=1e-5)


def test_fitted_temperature_recovers_scale(spark):
    rnd = random.Random(9)
    rows = []
    for _ in range(4000):
        logit = rnd.gauss(0, 1.5)
        truth = rnd.random() < 1 / (1 + math.exp(-logit))
        rows.append((1 / (1 + math.exp(-logit * 1.6)), int(truth)))  # overconfident by 1.6
    best = scoring.fit_temperature(spark.createDataFrame(rows, "raw_probability double, actual int")).first()
    assert best.temperature == pytest.approx(1.6, abs=0.15)


def test_scaled_training_rows_have_mean_zero(spark):
    df = spark.createDataFrame([(float(i % 7), 5.0) for i in range(100)], "a double, b double")
    scaler = scoring.fit_static_scaler(df, ["a", "b"])
    assert scaler.std["b"] == 1.0
    r = scoring.scale_static(df, scaler).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s"), F.avg("b").alias("b")).first()
    assert r.m == pytest.approx(0.0, abs=1e-9) and r.s == pytest.approx(1.0) and r.b == 0.0


def test_lines_of_blocks_are_those_of_their_bets_and_cost_little():
    import time

    rng = np.random.default_rng(5)
    blocks = []
    for n in (1, 2, 37, 500):
        share = np.where(rng.random(n) < 0.3, 1.0, rng.random(n) * 0.02)
        blocks.append((share, np.where(rng.random(n) < 0.1, np.inf, rng.random(n) * 100), np.where(rng.random(n) < 0.5, rng.random(n) + 0.3, -1.0)))
    blocks.append((np.full(60, 0.03), np.full(60, np.inf), np.where(np.arange(60) % 2 == 0, 0.5, -1.0)))
    for block, line in zip(blocks, ledger.lines_of_bets(blocks)):
        for start in [0.0, 1e-3, 0.5, 1.0, 7.0, 100.0, 4321.0, 1e5, *(rng.random(40) * 300)]:
            now = start
            for s, m, g in zip(*block):
                now += g * min(s * now, m)
            assert line(start) == pytest.approx(now, rel=1e-9, abs=1e-9)
    many = [(rng.random(500) * 0.02 + 1e-4, np.full(500, 100.0), np.where(rng.random(500) < 0.5, 0.8, -1.0)) for _ in range(400)]
    begin = time.process_time()
    ledger.lines_of_bets(many)
    assert time.process_time() - begin < 8  # 200,000 bets, each with a turn of its own
