"""Scoring from both sides, probability metrics and model reports."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.functions import calibrate, dates, names, ranks
from courtlens.operators.timeline import in_ranges


# ---- two views of one match --------------------------------------------------------------------


def combine_perspectives(df: DataFrame, keys: Sequence[str] = ("match_id", "match_num")) -> DataFrame:
    """One row per match from its two scored rows.

    ``df`` has player, opponent, label, prob and the keys. The probability of player one (by
    surname) is the mean of both views. Groups that are not two mirrored rows are dropped.
    """
    one, two = names.by_surname(F.col("player"), F.col("opponent"))
    sided = df.withColumns({"player_one": one, "player_two": two}).withColumn(
        "_is_one", F.col("player") == F.col("player_one"))
    grouped = sided.groupBy(*keys, "tourney_date", "player_one", "player_two").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_is_one").alias("_ones"),
        F.avg(F.when(F.col("_is_one"), F.col("prob")).otherwise(1 - F.col("prob"))).alias("raw_probability"),
        F.max(F.when(F.col("_is_one"), F.col("label")).otherwise(1 - F.col("label"))).alias("actual"),
    )
    return grouped.filter((F.col("_n") == 2) & (F.col("_ones") == 1)).drop("_n", "_ones").withColumn(
        "raw_logit", calibrate.to_logit(F.col("raw_probability")))


def dropped_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many matches and rows a key loses because its groups do not hold two rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count_if(F.col("n") != 2).alias("dropped_groups"),
        F.coalesce(F.sum(F.when(F.col("n") != 2, F.col("n"))), F.lit(0)).alias("dropped_rows"))


def as_predictions(combined: DataFrame, probability: Column | None = None) -> DataFrame:
    """Prediction columns: both probabilities, the predicted and the actual winner."""
    prob = F.col("raw_probability") if probability is None else probability
    return combined.withColumn("prob_one", prob).withColumns({
        "prob_two": 1 - F.col("prob_one"),
        "prediction": (F.col("prob_one") >= 0.5).cast("int"),
        "predicted_winner": F.when(F.col("prob_one") >= 0.5, "player_one").otherwise("player_two"),
        "actual_winner": F.when(F.col("actual") == 1, "player_one").otherwise("player_two"),
    })


def insights(df: DataFrame) -> DataFrame:
    """Confidence, odds, expected margin and the texts shown with a prediction."""
    confidence = F.greatest("prob_one", "prob_two")
    return df.withColumn("confidence", confidence).withColumns({
        "odds_one": calibrate.decimal_odds(F.col("prob_one")), "odds_two": calibrate.decimal_odds(F.col("prob_two")),
        "expected_margin": calibrate.expected_margin(F.col("confidence")),
        "score_word": calibrate.score_word(F.col("confidence")),
        "betting_advice": calibrate.betting_advice(F.col("confidence")),
    })


# ---- metrics -----------------------------------------------------------------------------------


def metrics_by(df: DataFrame, by: Sequence[str], prob: str = "prob_one", actual: str = "actual") -> DataFrame:
    """Accuracy, Brier score, log-loss (clip 1e-7) and count per group."""
    p, y = F.col(prob), F.col(actual)
    hit = ((p >= 0.5).cast("int") == y).cast("double")
    return df.groupBy(*by).agg(
        F.avg(hit).alias("accuracy"), F.avg(calibrate.squared_error(p, y)).alias("brier"),
        F.avg(calibrate.negative_log_likelihood(p, y, 1e-7)).alias("log_loss"), F.count(F.lit(1)).alias("matches"))


def auc_by(df: DataFrame, by: Sequence[str], prob: str = "prob_one", actual: str = "actual") -> DataFrame:
    """Exact area under the ROC curve per group, NaN with only one class.

    Equal scores are merged first. What lies below a score is counted inside ranges of (group,
    score) of about equal size, wherever the scores crowd; sums per range supply the rest.
    """
    keys = list(by)
    y = F.col(actual).cast("bigint")
    merged = df.groupBy(*keys, F.col(prob).alias("_p")).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    scores = in_ranges(merged, [*keys, "_p"])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = scores.groupBy(*keys, "_range").agg(F.sum("_neg").alias("_range_neg")).select(
        *keys, "_range", F.coalesce(F.sum("_range_neg").over(earlier), zero).alias("_offset"))
    below = Window.partitionBy(*keys, "_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    placed = scores.withColumn("_under", F.coalesce(F.sum("_neg").over(below), zero)).join(offsets, [*keys, "_range"])
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_offset") + F.col("_under") + F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return placed.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).otherwise(F.lit(float("nan"))).alias("auc"))


def year_metrics(df: DataFrame, prob: str = "prob_one") -> DataFrame:
    yearly = df.withColumn("year", dates.year_of(F.col("tourney_date")))
    return metrics_by(yearly, ["year"], prob).join(auc_by(yearly, ["year"], prob), "year")


def table_loss(df: DataFrame, prob: str = "prob_one", actual: str = "actual") -> DataFrame:
    p, y = F.col(prob), F.col(actual)
    return df.agg(F.avg(calibrate.negative_log_likelihood(p, y)).alias("nll"),
                  F.avg(calibrate.squared_error(p, y)).alias("brier"))


def confusion(df: DataFrame, prob: str = "prob_one", actual: str = "actual") -> DataFrame:
    """Confusion counts and the ratios made from them (0 when undefined)."""
    guess, truth = F.col(prob) >= 0.5, F.col(actual) == 1
    counts = df.agg(
        F.count_if(guess & truth).alias("true_positive"), F.count_if(~guess & ~truth).alias("true_negative"),
        F.count_if(guess & ~truth).alias("false_positive"), F.count_if(~guess & truth).alias("false_negative"))
    tp, tn, fp, fn = (F.col(c) for c in ("true_positive", "true_negative", "false_positive", "false_negative"))

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return counts.withColumns({
        "accuracy": share(tp + tn, tp + tn + fp + fn), "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn), "specificity": share(tn, tn + fp)})


def rank_pair_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy per unordered pair of rank buckets with small-sample flags."""
    low, high = F.least("rank_one", "rank_two"), F.greatest("rank_one", "rank_two")
    both = df.filter(F.col("rank_one").isNotNull() & F.col("rank_two").isNotNull())
    cells = both.groupBy(
        ranks.bucket_of(low, ranks.BUCKETS_PAIR).alias("player_rank_bucket"),
        ranks.bucket_of(high, ranks.BUCKETS_PAIR).alias("opponent_rank_bucket"),
    ).agg(F.avg((F.col("prediction") == F.col("actual")).cast("double")).alias("accuracy"),
          F.count(F.lit(1)).alias("sample_count"))
    return cells.withColumns({"small_sample": F.col("sample_count") < 30, "very_small_sample": F.col("sample_count") < 10})


def higher_rank_baseline(matches: DataFrame) -> DataFrame:
    both = matches.filter(F.col("winner_rank").isNotNull() & F.col("loser_rank").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("matches"),
                    F.avg((F.col("winner_rank") < F.col("loser_rank")).cast("double")).alias("accuracy"))


def cross_validation(folds: DataFrame) -> DataFrame:
    """Mean validation accuracy with a 95 % interval clipped to [0, 1], mean AUC and fold count.

    ``folds`` has name, accuracy and auc per fold.
    """
    out = folds.agg(
        F.avg("accuracy").alias("val_accuracy_mean"), F.coalesce(F.stddev_pop("accuracy"), F.lit(0.0)).alias("val_accuracy_std"),
        F.avg("auc").alias("val_auc_mean"), F.count(F.lit(1)).alias("folds"))
    delta = F.col("val_accuracy_std") * 1.96
    return out.withColumns({
        "interval_low": F.greatest(F.lit(0.0), F.col("val_accuracy_mean") - delta),
        "interval_high": F.least(F.lit(1.0), F.col("val_accuracy_mean") + delta)})


def correlations(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature pair in one pass over the table; 0 when undefined."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                      F.coalesce(F.nanvl(F.col(f"_{i}"), F.lit(0.0)), F.lit(0.0)).alias("correlation"))
             for i, (a, b) in enumerate(pairs)]
    cells += [F.struct(F.lit(a).alias("feature_a"), F.lit(a).alias("feature_b"), F.lit(1.0).alias("correlation"))
              for a in fields]
    return row.select(F.inline(F.array(*cells)))


def quality_counts(df: DataFrame, fields: Sequence[str], history_size: str | None = None) -> DataFrame:
    """Null and non-finite counts per column, rows and the share of rows without history."""
    counts = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        value = F.col(f).cast("double")
        counts += [F.count_if(value.isNull()).alias(f"_n{i}"),
                   F.count_if(F.isnan(value) | (F.abs(value) == float("inf"))).alias(f"_i{i}")]
    cold = F.lit(0.0) if history_size is None else F.avg((F.col(history_size) == 0).cast("double"))
    row = df.agg(*counts, cold.alias("_cold"))
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"_n{i}").alias("nulls"), F.col(f"_i{i}").alias("not_finite"))
             for i, f in enumerate(fields)]
    return row.select(F.inline(F.array(*cells)), F.col("_rows").alias("rows"), F.col("_cold").alias("cold_share"))


def split_counts(df: DataFrame, split: Column) -> DataFrame:
    return df.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("rows"))


# ---- small report projections ------------------------------------------------------------------


def min_max_long(df: DataFrame, keys: Sequence[str], ranges) -> DataFrame:
    """Long table of features scaled to [0, 1] by fixed ranges; an empty range gives 0.5."""
    cells = []
    for name, low, high, inverted in ranges:
        if low == high:
            scaled = F.lit(0.5)
        else:
            scaled = (F.coalesce(F.col(name).cast("double"), F.lit(0.0)) - low) / (high - low)
            scaled = 1 - scaled if inverted else scaled
            scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
        cells.append(F.struct(F.lit(name).alias("feature"), scaled.alias("value")))
    return df.select(*keys, F.inline(F.array(*cells)))


def relative_probability(rows: DataFrame) -> DataFrame:
    """``a / (a + b)`` of combined serve and return for matches aligned by index."""
    def combined(side):
        half = F.lit(0.5)
        serve = F.coalesce(F.nullif(F.col(f"{side}_serve_pct"), F.lit(0.0)), half)
        ret = F.coalesce(F.nullif(F.col(f"{side}_return_pct"), F.lit(0.0)), half)
        return (serve + ret) / 2

    one = combined("one") / (combined("one") + combined("two")) * 100
    return rows.withColumns({
        "one_win_pct": F.when(F.col("one_serve_pct").isNotNull(), one),
        "two_win_pct": F.when(F.col("two_serve_pct").isNotNull(), 100 - one)})
