import math

import pytest
from pyspark.sql import functions as F

from courtlens.functions import calibrate, decay, names, ranks, rates, staking


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_safe_ratio(spark):
    assert value(spark, rates.safe_ratio(F.lit(3), F.lit(0))) == 0.0
    assert value(spark, rates.safe_ratio(F.lit(None).cast("int"), F.lit(4))) == 0.0
    assert value(spark, rates.safe_ratio(F.lit(3), F.lit(4))) == 0.75


def test_rank_strength(spark):
    assert value(spark, ranks.rank_strength(F.lit(1))) == 1.0
    assert value(spark, ranks.rank_strength(F.lit(5000))) == 0.0
    assert value(spark, ranks.rank_strength(F.lit(None).cast("int"))) == 0.0
    assert value(spark, ranks.rank_strength(F.lit(100))) == pytest.approx(1 - math.log(100) / math.log(2000))


def test_decay_weights_sum_to_one_and_grow(spark):
    weights = value(spark, decay.half_life_weights(F.lit(10), F.lit(3.0)))
    assert sum(weights) == pytest.approx(1.0)
    assert weights == sorted(weights)
    assert weights[-1] / weights[-4] == pytest.approx(2.0)


def test_slug(spark):
    assert value(spark, names.slug(F.lit(" Gaël  Monfils Jr. "))) == "gael-monfils-jr"
    assert value(spark, names.slug(F.lit("Félix Auger-Aliassime"))) == "felix-auger-aliassime"


def test_surname_order(spark):
    one, two = names.by_surname(F.lit("Zoe Adams"), F.lit("Adam Zorn"))
    assert value(spark, one) == "Zoe Adams" and value(spark, two) == "Adam Zorn"
    one, two = names.by_surname(F.lit("Mischa Zverev"), F.lit("Alexander Zverev"))
    assert (value(spark, one), value(spark, two)) == ("Alexander Zverev", "Mischa Zverev")


def test_calibration(spark):
    p = F.lit(0.7)
    assert value(spark, calibrate.with_temperature(p, F.lit(1.0))) == pytest.approx(0.7)
    assert value(spark, calibrate.with_temperature(p, F.lit(2.0))) < 0.7
    assert value(spark, calibrate.calibrated(p, F.lit(None).cast("string"), F.lit(2.0), F.lit(1.0), F.lit(0.0))) == 0.7
    assert value(spark, calibrate.expected_margin(F.lit(0.85))) == pytest.approx(5.5)


def test_stakes(spark):
    def stake(name, prob, odds, bankroll=100.0, **options):
        return value(spark, staking.get_strategy(name)(F.lit(prob), F.lit(odds), **options).of(F.lit(bankroll)))

    assert stake("flat", 0.6, 2.0, stake_units=5.0) == 5.0
    assert stake("flat", 0.6, 2.0, bankroll=3.0, stake_units=5.0) == 3.0
    assert stake("full_kelly", 0.6, 2.0) == pytest.approx(3.0)
    assert stake("quarter_kelly", 0.51, 2.0) == pytest.approx(0.5)
    assert stake("full_kelly", 0.4, 2.0) == 0.0
    assert stake("full_kelly", 0.9, 1.0) == 0.0
    assert stake("threshold_stake", 0.64, 2.0) == pytest.approx(2.5)
    assert stake("odds_weighted_stake", 0.64, 1.8) == pytest.approx(2.5)
    with pytest.raises(ValueError):
        staking.get_strategy("martingale")


def test_user_strategy(spark):
    staking.register_strategy("half_unit", lambda prob, odds, **_: staking.Stake(amount=F.lit(0.5)))
    try:
        assert value(spark, staking.get_strategy("half_unit")(F.lit(0.6), F.lit(2.0)).of(F.lit(10.0))) == 0.5
    finally:
        staking.STRATEGIES.pop("half_unit")
