"""Scoring, calibration, metrics and fitted steps (families C20-C29, D5-D6, D10, D16, E6-E11, E15, E22, E24, E30-E31, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.functions import calibrate, dates, ranks, rates
from courtlens.operators import evaluate, joins, orient, sequences
from courtlens.operators.asof import asof_join
from courtlens.plans import features, scoring
from courtlens.queries.base import cte, dual, match_table, player_table, query, r6, rounded, sql_r6
from courtlens.queries import views as _views  # noqa: F401  (registers the scored building block)
from courtlens.queries.history import rated, skilled, staged_skills
from courtlens.session import cut_from, cut_lineage

_MATCH = ["match_id", "match_num"]
TRAIN_UNTIL, VALIDATE_UNTIL = 19991231, 20001231


def scored_sides(spark, folder):
    """Both views of every match with a probability from the rank gap."""
    df = dual(spark, folder)
    gap = F.col("opponent_rank") - F.col("player_rank")
    prob = F.when(gap.isNull(), 0.5).otherwise(1 / (1 + F.exp(-gap / 50.0)))
    return df.select("match_id", "match_num", "tourney_date", "player", "opponent", "label", prob.alias("prob"))


def combined(spark, folder):
    return evaluate.combine_perspectives(scored_sides(spark, folder))


def predictions(spark, folder):
    """Combined predictions with the match details."""
    info = match_table(spark, folder).select(
        "match_num", "tourney_name", "tourney_id", "tourney_level", "surface", "round",
        F.when(F.col("winner_name") < F.col("loser_name"), F.col("winner_rank")).otherwise(F.col("loser_rank")).alias("rank_one"),
        F.when(F.col("winner_name") < F.col("loser_name"), F.col("loser_rank")).otherwise(F.col("winner_rank")).alias("rank_two"))
    level = orient.collapsed_level(F.col("tourney_level"))
    return evaluate.as_predictions(combined(spark, folder)).join(info, "match_num").withColumn("tourney_level", level)


# ---- calibration functions ----------------------------------------------------------------------

_LOGIT = "ln(greatest(least({p}, 1 - 1e-6), 1e-6) / (1 - greatest(least({p}, 1 - 1e-6), 1e-6)))"


def _logit(p: str) -> str:
    return _LOGIT.format(p=p)


@query("c20_logits", "scored", f"""
SELECT match_num, round({_logit('raw_one')}, 6) + 0.0 AS logit, round(1 / (1 + exp(-{_logit('raw_one')})), 6) + 0.0 AS back FROM scored
""")
def _(spark, folder):
    logit = calibrate.to_logit(F.col("raw_probability"))
    return combined(spark, folder).select("match_num", r6(logit).alias("logit"), r6(calibrate.to_probability(logit)).alias("back"))


@query("c21_temperature_scaled", "scored", f"SELECT match_num, round(1 / (1 + exp(-{_logit('raw_one')} / 1.2)), 6) + 0.0 AS prob FROM scored")
def _(spark, folder):
    value = calibrate.with_temperature(F.col("raw_probability"), F.lit(calibrate.AS_AT_TEMPERATURE))
    return combined(spark, folder).select("match_num", r6(value).alias("prob"))


@query("c22_platt_scaled", "scored", f"SELECT match_num, round(1 / (1 + exp(-(0.9 * {_logit('raw_one')} + 0.05))), 6) + 0.0 AS prob FROM scored")
def _(spark, folder):
    value = calibrate.with_platt(F.col("raw_probability"), F.lit(0.9), F.lit(0.05))
    return combined(spark, folder).select("match_num", r6(value).alias("prob"))


@query("c23_calibration_by_method", "scored", f"""
SELECT match_num, round(CASE match_num % 4 WHEN 0 THEN 1 / (1 + exp(-{_logit('raw_one')} / 0.72)) WHEN 1 THEN 1 / (1 + exp(-(1.1 * {_logit('raw_one')} - 0.2)))
  WHEN 2 THEN 1 / (1 + exp(-{_logit('raw_one')} / 2.0)) ELSE raw_one END, 6) + 0.0 AS prob FROM scored
""")
def _(spark, folder):
    case = F.col("match_num") % 4
    method = F.when(case == 0, "temperature").when(case == 1, "platt").when(case == 2, "platt")
    override = F.when(case == 2, F.lit(2.0))
    value = calibrate.calibrated(F.col("raw_probability"), method, F.lit(0.72), F.lit(1.1), F.lit(-0.2), override)
    return combined(spark, folder).select("match_num", r6(value).alias("prob"))


@query("c24_recalibrated_predictions", "scored", f"""
SELECT match_num, round(p, 6) + 0.0 AS prob_one, round(1 - p, 6) + 0.0 AS prob_two FROM (
  SELECT match_num, CASE WHEN match_num % 5 = 0 THEN raw_one ELSE 1 / (1 + exp(-{_logit('raw_one')} / 0.72)) END AS p FROM scored)
""")
def _(spark, folder):
    saved = evaluate.as_predictions(combined(spark, folder)).withColumn(
        "raw_probability", F.when(F.col("match_num") % 5 != 0, F.col("raw_probability")))
    fresh = F.coalesce(calibrate.with_temperature(F.col("raw_probability"), F.lit(0.72)), F.col("prob_one"))
    # a saved row without a raw probability keeps the stored one
    kept = F.when(F.col("raw_probability").isNull(), F.col("prob_one")).otherwise(fresh)
    return saved.select("match_num", r6(kept).alias("prob_one"), r6(1 - kept).alias("prob_two"))


@query("c25_confidence_and_odds", "scored", """
SELECT match_num, round(greatest(raw_one, 1 - raw_one), 6) + 0.0 AS confidence, round(1 / greatest(raw_one, 1e-6), 3) AS odds_one, round(1 / greatest(1 - raw_one, 1e-6), 3) AS odds_two FROM scored
""")
def _(spark, folder):
    df = evaluate.insights(evaluate.as_predictions(combined(spark, folder)))
    return df.select("match_num", r6("confidence").alias("confidence"), "odds_one", "odds_two")


@query("c26_margin_c27_word_c28_advice", "scored", """
SELECT match_num, round(CASE WHEN c >= 0.9 THEN 6.0 WHEN c >= 0.8 THEN 5 + (c - 0.8) * 10 WHEN c >= 0.7 THEN 4 + (c - 0.7) * 10 WHEN c >= 0.6 THEN 3 + (c - 0.6) * 10
    WHEN c >= 0.55 THEN 2.5 + (c - 0.55) * 10 WHEN c >= 0.5 THEN 2 + (c - 0.5) * 10 ELSE 0 END::DOUBLE, 6) + 0.0 AS expected_margin,
  CASE WHEN c >= 0.95 THEN 'bagel' WHEN c >= 0.9 THEN 'smashing' WHEN c >= 0.8 THEN 'dominant' WHEN c >= 0.65 THEN 'likely' WHEN c >= 0.55 THEN 'close' ELSE 'toss-up' END AS score_word,
  CASE WHEN c < 0.58 THEN 'Probably a bad bet' WHEN c >= 0.7 THEN 'Maybe a good bet' ELSE 'Proceed with caution' END AS betting_advice
FROM (SELECT match_num, greatest(raw_one, 1 - raw_one) AS c FROM scored)
""")
def _(spark, folder):
    df = evaluate.insights(evaluate.as_predictions(combined(spark, folder)))
    return df.select("match_num", r6("expected_margin").alias("expected_margin"), "score_word", "betting_advice")


@query("c29_fresh_minus_frozen", "scored", f"""
SELECT match_num, round(f - z, 6) + 0.0 AS probability_delta, match_num % 2 = 0 AS override_used
FROM (SELECT match_num, 1 / (1 + exp(-{_logit('raw_one')} / 1.2)) AS z, 1 / (1 + exp(-{_logit('raw_one')} / 0.72)) AS f FROM scored)
""")
def _(spark, folder):
    base = combined(spark, folder)
    frozen = base.select("match_num", calibrate.with_temperature(F.col("raw_probability"), F.lit(1.2)).alias("frozen"))
    fresh = base.select("match_num", calibrate.with_temperature(F.col("raw_probability"), F.lit(0.72)).alias("fresh"),
                        F.when(F.col("match_num") % 2 == 0, "fresh").otherwise("frozen").alias("feature_mode"))
    return frozen.join(fresh, "match_num").select(
        "match_num", r6(F.col("fresh") - F.col("frozen")).alias("probability_delta"),
        (F.col("feature_mode") == "fresh").alias("override_used"))


@query("d16_frozen_and_fresh", "scored", f"""
SELECT match_num, round(1 / (1 + exp(-{_logit('raw_one')} / 1.2)), 6) + 0.0 AS frozen, round(1 / (1 + exp(-{_logit('raw_one')} / 0.72)), 6) + 0.0 AS fresh FROM scored
""")
def _(spark, folder):
    base = combined(spark, folder)
    a = base.select("match_num", r6(calibrate.with_temperature(F.col("raw_probability"), F.lit(1.2))).alias("frozen"))
    b = base.select("match_num", r6(calibrate.with_temperature(F.col("raw_probability"), F.lit(0.72))).alias("fresh"))
    return a.join(b, "match_num")


# ---- combining and joining ----------------------------------------------------------------------

@query("d10_mirrored_pairs_e06_combined", "scored", f"""
SELECT match_num, player_one, player_two, round(raw_one, 6) + 0.0 AS raw_probability, round({_logit('raw_one')}, 6) + 0.0 AS raw_logit, actual FROM scored
""")
def _(spark, folder):
    return combined(spark, folder).select(
        "match_num", "player_one", "player_two", r6("raw_probability").alias("raw_probability"), r6("raw_logit").alias("raw_logit"), "actual")


@query("d10_dropped_by_literal_key", "dual", """
SELECT count(*) FILTER (WHERE n <> 2) AS dropped_groups, CAST(coalesce(sum(n) FILTER (WHERE n <> 2), 0) AS BIGINT) AS dropped_rows FROM (SELECT match_id, count(*) AS n FROM dual GROUP BY 1)
""")
def _(spark, folder):
    return evaluate.dropped_by_key(scored_sides(spark, folder), ["match_id"])


@query("d05_predictions_with_row_keys", "dual", """
SELECT player, opponent, match_id, match_num, tourney_date, label, round(CASE WHEN opponent_rank IS NULL OR player_rank IS NULL THEN 0.5 ELSE 1 / (1 + exp(-(opponent_rank - player_rank) / 50.0)) END, 6) + 0.0 AS prob FROM dual
""")
def _(spark, folder):
    return rounded(scored_sides(spark, folder), ["player", "opponent", "match_id", "match_num", "tourney_date", "label"], ["prob"])


@query("d06_match_info", "dual", """
SELECT a.match_id, a.match_num, coalesce(i.tourney_name, '') AS tourney_name, coalesce(i.surface, '') AS surface, coalesce(i.round, '') AS round
FROM (SELECT DISTINCT match_id, match_num FROM dual) a
LEFT JOIN (SELECT * FROM dual WHERE match_num % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY match_num, player) = 1) i ON a.match_id = i.match_id
""")
def _(spark, folder):
    known = dual(spark, folder, *joins.INFO).filter(F.col("match_num") % 7 != 0)
    base = combined(spark, folder).select("match_id", "match_num")
    return joins.with_match_info(base, known).select("match_id", "match_num", "tourney_name", "surface", "round")


# ---- metrics ------------------------------------------------------------------------------------

cte("year_auc", ("scored",), """
SELECT year, (sum(CASE WHEN actual = 1 THEN avg_rank ELSE 0 END) - p * (p + 1) / 2.0) / (p * n) AS auc FROM (
  SELECT *, sum(actual) OVER (PARTITION BY year) AS p, sum(1 - actual) OVER (PARTITION BY year) AS n,
    rank() OVER (PARTITION BY year ORDER BY s) + (count(*) OVER (PARTITION BY year, s) - 1) / 2.0 AS avg_rank
  FROM (SELECT tourney_date // 10000 AS year, round(raw_one, 9) AS s, actual FROM scored)) GROUP BY year, p, n
""")


@query("e07_year_metrics_e08_auc", "scored year_auc", """
SELECT CAST(m.year AS INTEGER) AS year, round(accuracy, 6) + 0.0 AS accuracy, round(brier, 6) + 0.0 AS brier, round(log_loss, 6) + 0.0 AS log_loss, matches, round(auc, 6) + 0.0 AS auc FROM (
  SELECT tourney_date // 10000 AS year, avg(CAST(CAST(raw_one >= 0.5 AS INTEGER) = actual AS DOUBLE)) AS accuracy, avg((raw_one - actual) * (raw_one - actual)) AS brier,
    avg(-(actual * ln(greatest(least(raw_one, 1 - 1e-7), 1e-7)) + (1 - actual) * ln(1 - greatest(least(raw_one, 1 - 1e-7), 1e-7)))) AS log_loss, count(*) AS matches FROM scored GROUP BY 1) m JOIN year_auc a ON a.year = m.year
""")
def _(spark, folder):
    # nine decimals, so that equal rank gaps tie in both engines
    df = evaluate.as_predictions(combined(spark, folder)).withColumn("score", F.round("prob_one", 9))
    yearly = df.withColumn("year", dates.year_of(F.col("tourney_date")))
    out = evaluate.metrics_by(yearly, ["year"]).join(evaluate.auc_by(yearly, ["year"], "score"), "year")
    return rounded(out, ["year", "matches"], ["accuracy", "brier", "log_loss", "auc"])


@query("e09_loss_of_table", "scored", f"""
SELECT round(avg(-(actual * ln(greatest(least(raw_one, 1 - 1e-6), 1e-6)) + (1 - actual) * ln(1 - greatest(least(raw_one, 1 - 1e-6), 1e-6)))), 6) + 0.0 AS nll, round(avg((raw_one - actual) ** 2), 6) + 0.0 AS brier FROM scored
""")
def _(spark, folder):
    return rounded(evaluate.table_loss(evaluate.as_predictions(combined(spark, folder))), [], ["nll", "brier"])


@query("e10_confusion", "scored", """
SELECT tp AS true_positive, tn AS true_negative, fp AS false_positive, fn AS false_negative, round((tp + tn) / (tp + tn + fp + fn), 6) + 0.0 AS accuracy, round(tp / (tp + fp), 6) + 0.0 AS precision,
  round(tp / (tp + fn), 6) + 0.0 AS recall, round(tn / (tn + fp), 6) + 0.0 AS specificity FROM (
  SELECT count(*) FILTER (WHERE raw_one >= 0.5 AND actual = 1) AS tp, count(*) FILTER (WHERE raw_one < 0.5 AND actual = 0) AS tn,
    count(*) FILTER (WHERE raw_one >= 0.5 AND actual = 0) AS fp, count(*) FILTER (WHERE raw_one < 0.5 AND actual = 1) AS fn FROM scored)
""")
def _(spark, folder):
    return rounded(evaluate.confusion(evaluate.as_predictions(combined(spark, folder))),
                   ["true_positive", "true_negative", "false_positive", "false_negative"], ["accuracy", "precision", "recall", "specificity"])


def _pair_bucket(r: str) -> str:
    return f"CASE WHEN {r} <= 5 THEN '1-5' WHEN {r} <= 10 THEN '6-10' WHEN {r} <= 20 THEN '11-20' WHEN {r} <= 50 THEN '21-50' WHEN {r} <= 100 THEN '51-100' ELSE '101+' END"


@query("e11_rank_pair_accuracy", "scored", f"""
SELECT {_pair_bucket('least(winner_rank, loser_rank)')} AS player_rank_bucket, {_pair_bucket('greatest(winner_rank, loser_rank)')} AS opponent_rank_bucket,
  round(avg(CAST(CAST(raw_one >= 0.5 AS INTEGER) = actual AS DOUBLE)), 6) + 0.0 AS accuracy, count(*) AS sample_count, count(*) < 30 AS small_sample, count(*) < 10 AS very_small_sample
FROM scored WHERE winner_rank IS NOT NULL AND loser_rank IS NOT NULL GROUP BY 1, 2
""")
def _(spark, folder):
    return rounded(evaluate.rank_pair_accuracy(predictions(spark, folder)),
                   ["player_rank_bucket", "opponent_rank_bucket", "sample_count", "small_sample", "very_small_sample"], ["accuracy"])


@query("e15_cross_validation_a09_metric_documents", "scored year_auc", """
SELECT round(avg(accuracy), 6) + 0.0 AS val_accuracy_mean, round(stddev_pop(accuracy), 6) + 0.0 AS val_accuracy_std, round(avg(auc), 6) + 0.0 AS val_auc_mean, count(*) AS folds,
  round(greatest(0.0, avg(accuracy) - 1.96 * stddev_pop(accuracy)), 6) + 0.0 AS interval_low, round(least(1.0, avg(accuracy) + 1.96 * stddev_pop(accuracy)), 6) + 0.0 AS interval_high
FROM (SELECT tourney_date // 10000 AS year, avg(CAST(CAST(raw_one >= 0.5 AS INTEGER) = actual AS DOUBLE)) AS accuracy FROM scored GROUP BY 1) m JOIN year_auc a ON a.year = m.year
""")
def _(spark, folder):
    from courtlens.sources import documents
    df = evaluate.as_predictions(combined(spark, folder)).withColumn("score", F.round("prob_one", 9))
    yearly = df.withColumn("year", dates.year_of(F.col("tourney_date")))
    out = evaluate.metrics_by(yearly, ["year"]).join(evaluate.auc_by(yearly, ["year"], "score"), "year")
    text = documents.fold_documents(out)
    folds = documents.fold_rows(documents.parsed(text))
    return rounded(evaluate.cross_validation(folds), ["folds"], [
        "val_accuracy_mean", "val_accuracy_std", "val_auc_mean", "interval_low", "interval_high"])


_E22 = ["serve_pct", "return_pct", "player_ace_rate", "player_df_rate", "player_bp_save_pct"]


@query("e22_feature_correlations", "rates", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(coalesce(corr({a}, {b}), 0.0), 6) + 0.0 AS correlation FROM rates"
    for i, a in enumerate(_E22) for b in _E22[i:]))
def _(spark, folder):
    df = rated(spark, folder).withColumns({"serve_pct": rates.serve_pct("player"), "return_pct": rates.return_pct("opp")})
    return rounded(evaluate.correlations(df, _E22), ["feature_a", "feature_b"], ["correlation"])


@query("e30_quality_counts", "rolled", """
SELECT feature, nulls, CAST(0 AS BIGINT) AS not_finite, n AS rows, round(cold, 6) + 0.0 AS cold_share FROM (
  SELECT unnest(['player_ace_rate_roll10', 'days_since_last_match', 'opponent_rank']) AS feature,
    unnest([count(*) FILTER (WHERE player_ace_rate_roll10 IS NULL), 0, count(*) FILTER (WHERE opponent_rank IS NULL)]) AS nulls, count(*) AS n,
    avg(CAST(player_ace_rate_roll10 IS NULL AS DOUBLE)) AS cold FROM rolled)
""")
def _(spark, folder):
    df = features.with_rolling(rated(spark, folder), windows=(10,)).withColumn(
        "history", F.when(F.col("player_ace_rate_roll10").isNull(), 0).otherwise(1))
    out = evaluate.quality_counts(df, ["player_ace_rate_roll10", "days_since_last_match", "opponent_rank"], "history")
    return rounded(out, ["feature", "nulls", "not_finite", "rows"], ["cold_share"])


@query("e31_split_counts", "dual", f"""
SELECT CASE WHEN tourney_date <= {TRAIN_UNTIL} THEN 'train' WHEN tourney_date <= {VALIDATE_UNTIL} THEN 'validation' ELSE 'test' END AS split, count(*) AS rows FROM dual GROUP BY 1
""")
def _(spark, folder):
    return evaluate.split_counts(dual(spark, folder), orient.temporal_split(F.col("tourney_date"), TRAIN_UNTIL, VALIDATE_UNTIL))


_GRID = "1 / (1 + exp(-{l} / t))"


@query("j07_fitted_temperature", "scored", f"""
WITH s AS (SELECT {_logit('raw_one')} AS l, actual AS y FROM scored WHERE tourney_date > {TRAIN_UNTIL} AND tourney_date <= {VALIDATE_UNTIL}),
g1 AS (SELECT i * CAST(0.05 AS DOUBLE) AS t FROM range(1, 51) r(i)),
l1 AS (SELECT t, avg(-(y * ln(greatest(least(1/(1+exp(-l/t)), 1-1e-6), 1e-6)) + (1-y) * ln(1 - greatest(least(1/(1+exp(-l/t)), 1-1e-6), 1e-6)))) AS nll FROM s CROSS JOIN g1 GROUP BY t),
g2 AS (SELECT (SELECT arg_min(t, nll) FROM l1) + i * CAST(0.002 AS DOUBLE) AS t FROM range(-25, 26) r(i)),
l2 AS (SELECT t, avg(-(y * ln(greatest(least(1/(1+exp(-l/t)), 1-1e-6), 1e-6)) + (1-y) * ln(1 - greatest(least(1/(1+exp(-l/t)), 1-1e-6), 1e-6)))) AS nll FROM s CROSS JOIN (SELECT t FROM g2 WHERE t >= 0.01 AND t <= 2.5) GROUP BY t)
SELECT round(arg_min(t, nll), 6) + 0.0 AS temperature, round(min(nll), 6) + 0.0 AS nll FROM l2
""")
def _(spark, folder):
    hold_out = combined(spark, folder).filter((F.col("tourney_date") > TRAIN_UNTIL) & (F.col("tourney_date") <= VALIDATE_UNTIL))
    return rounded(scoring.fit_temperature(hold_out), [], ["temperature", "nll"])


def _newton(steps: int) -> str:
    """Slope a and intercept b of a logistic regression of y on l in table s, by Newton steps."""
    out = ["n0 AS (SELECT CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)"]
    for i in range(steps):
        out.append(f"""n{i + 1} AS (SELECT any_value(a) - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, any_value(b) - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM (
  SELECT any_value(a) AS a, any_value(b) AS b, sum((p - y) * l) AS ga, sum(p - y) AS gb, sum(p * (1 - p) * l * l) AS haa, sum(p * (1 - p) * l) AS hab, sum(p * (1 - p)) AS hbb
  FROM (SELECT a, b, l, y, 1 / (1 + exp(-(a * l + b))) AS p FROM s CROSS JOIN n{i})) GROUP BY ga, gb, haa, hab, hbb)""")
    return ",\n".join(out)


@query("j08_fitted_platt", "scored", f"""
WITH s AS (SELECT {_logit('raw_one')} AS l, actual AS y FROM scored WHERE tourney_date > {TRAIN_UNTIL} AND tourney_date <= {VALIDATE_UNTIL}),
{_newton(10)},
t AS (SELECT greatest(least(1 / (1 + exp(-(a * {_logit('raw_one')} + b))), 1 - 1e-6), 1e-6) AS p, actual AS y, a, b FROM scored CROSS JOIN n10 WHERE tourney_date > {VALIDATE_UNTIL})
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 4) + 0.0 AS nll, round(avg((p - y) * (p - y)), 4) + 0.0 AS brier,
  round(any_value(a), 4) + 0.0 AS platt_a, round(any_value(b), 4) + 0.0 AS platt_b FROM t
""")
def _(spark, folder):
    table = combined(spark, folder)
    a, b = scoring.fit_platt(table.filter((F.col("tourney_date") > TRAIN_UNTIL) & (F.col("tourney_date") <= VALIDATE_UNTIL)))
    fitted = table.filter(F.col("tourney_date") > VALIDATE_UNTIL).withColumn(
        "platt", calibrate.with_platt(F.col("raw_probability"), F.lit(a), F.lit(b)))
    loss = evaluate.table_loss(fitted, "platt").withColumns({"platt_a": F.lit(a), "platt_b": F.lit(b)})
    return loss.select(*[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in loss.columns])


# ---- scalers ------------------------------------------------------------------------------------

_SF = ["serve_skill", "return_skill", "opp_serve_skill", "opp_return_skill"]


@query("j02_static_scaler", "edged", " UNION ALL ".join(f"""
SELECT CAST({i} AS INTEGER) AS position, '{f}' AS feature, round(avg({f}), 6) + 0.0 AS mean, round(coalesce(nullif(stddev_pop({f}), 0), 1.0), 6) + 0.0 AS std FROM edged WHERE tourney_date <= {TRAIN_UNTIL}
""" for i, f in enumerate(["serve_vs_return_edge", "return_vs_serve_edge", "net_edge"])))
def _(spark, folder):
    df = features.with_edges(features.with_opponent_skills(staged_skills(spark, folder)))
    stats = scoring.scaler_stats(df.filter(F.col("tourney_date") <= TRAIN_UNTIL), ["serve_vs_return_edge", "return_vs_serve_edge", "net_edge"])
    return rounded(stats, ["position", "feature"], ["mean", "std"])


@query("j01_sequence_scaler", "skilled", " UNION ALL ".join(f"""
SELECT CAST({i} AS INTEGER) AS position, '{f}' AS feature, round(avg(x.v{i}), 6) + 0.0 AS mean, round(coalesce(nullif(stddev_pop(x.v{i}), 0), 1.0), 6) + 0.0 AS std FROM (
  SELECT unnest(seq) AS x FROM (SELECT tourney_date, list({{'v0': serve_skill, 'v1': return_skill, 'v2': days_since_last_match}}) OVER (PARTITION BY player ORDER BY tourney_date, match_num ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seq FROM skilled) WHERE len(seq) = 10 AND tourney_date <= {TRAIN_UNTIL})
""" for i, f in enumerate(["serve_skill", "return_skill", "days_since_last_match"])))
def _(spark, folder):
    fields = ["serve_skill", "return_skill", "days_since_last_match"]
    df = sequences.row_sequences(skilled(spark, folder), fields).filter(F.col("tourney_date") <= TRAIN_UNTIL)
    return rounded(scoring.scaler_stats(scoring.valid_steps(df), fields), ["position", "feature"], ["mean", "std"])


@query("j01_scaled_sequences_have_mean_zero", "player_count", """
SELECT unnest(['serve_skill', 'return_skill']) AS feature, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS std FROM player_count
""")
def _(spark, folder):
    fields = ["serve_skill", "return_skill"]
    df = cut_lineage(sequences.row_sequences(skilled(spark, folder), fields).select("tourney_date", "sequence", "mask"))
    train = df.filter(F.col("tourney_date") <= TRAIN_UNTIL)
    scaler = scoring.fit_sequence_scaler(train, fields)
    scaled = train.withColumn("sequence", scoring.scale_sequence(F.col("sequence"), F.col("mask"), scaler, fields))
    return rounded(scoring.scaler_stats(scoring.valid_steps(scaled), fields), ["feature"], ["mean", "std"])


# ---- fitted models: rows are checked by invariants in the tests ---------------------------------

def feature_table(spark, folder):
    """Full feature rows with styles, sequences, scaling applied and the split."""
    table = cut_from(spark, lambda: _unscaled(spark, folder))
    train = table.filter("split = 'train'")
    seq_scaler = scoring.fit_sequence_scaler(train, features.SEQUENCE_FEATURES)
    static_scaler = scoring.fit_static_scaler(train, features.STATIC_FEATURES)
    scaled = scoring.scale_static(table, static_scaler)
    return scaled.withColumn("sequence", scoring.scale_sequence(
        F.col("sequence"), F.col("mask"), seq_scaler, features.SEQUENCE_FEATURES))


def _unscaled(spark, folder):
    base = features.match_features(rated(spark, folder), stage=cut_lineage)
    styled = scoring.with_style(base, F.col("tourney_date") <= TRAIN_UNTIL)
    opp = asof_join(styled, styled, left_key="opponent", right_key="player", day="tourney_date", number="match_num",
                    values=["player_style_cluster"], prefix="asof_")
    full = opp.withColumn("opp_style_cluster", F.coalesce("asof_player_style_cluster", F.lit(0))).withColumn(
        "style_matchup", scoring.style_matchup(F.col("player_style_cluster"), F.col("opp_style_cluster")))
    seq = sequences.row_sequences(full, features.SEQUENCE_FEATURES)
    keep = seq.select("player", "opponent", "match_id", "match_num", "tourney_date", "label", "sequence", "mask",
                      *[rates.finite_or_zero(F.col(s)).alias(s) for s in features.STATIC_FEATURES],
                      orient.temporal_split(F.col("tourney_date"), TRAIN_UNTIL, VALIDATE_UNTIL).alias("split"))
    return keep


@query("j03_style_clusters_d02_c15")
def _(spark, folder):
    base = cut_lineage(features.with_rolling(rated(spark, folder), windows=(30,)).select(
        "player", "opponent", "tourney_date", "match_num", *scoring.STYLE_INPUT))
    styled = scoring.with_style(base, F.col("tourney_date") <= TRAIN_UNTIL)
    joined = asof_join(styled, styled, left_key="opponent", right_key="player", day="tourney_date", number="match_num",
                       values=["player_style_cluster"], prefix="opp_")
    opp = F.coalesce("opp_player_style_cluster", F.lit(0))
    return joined.select("player", "match_num", "player_style_cluster", opp.alias("opp_style_cluster"),
                         scoring.style_matchup(F.col("player_style_cluster"), opp).alias("style_matchup"))


def _fitted(spark, folder):
    table = feature_table(spark, folder)
    model = scoring.fit_model(table.filter("split = 'train'"), features.SEQUENCE_FEATURES, features.STATIC_FEATURES)
    return table, model


@query("j04_fitted_model_j06_batch_scores")
def _(spark, folder):
    table, model = _fitted(spark, folder)
    scored = model.score(table.filter("split = 'test'"))
    return evaluate.as_predictions(evaluate.combine_perspectives(scored)).select(
        "match_id", "match_num", "tourney_date", "player_one", "player_two", "raw_probability", "prob_one", "prediction", "actual")


@query("j05_sweep_g06_best_trial")
def _(spark, folder):
    table = feature_table(spark, folder)
    trials = scoring.sweep(table.filter("split = 'train'"), table.filter("split = 'validation'"),
                           features.SEQUENCE_FEATURES, features.STATIC_FEATURES)
    return scoring.best_trial(trials)


@query("j09_importance_g02_top_features_e24_shares")
def _(spark, folder):
    _, model = _fitted(spark, folder)
    table = scoring.top_features(scoring.importance(spark, model, features.SEQ_LEN))
    return scoring.importance_shares(table)


@query("j10_shuffled_label_check")
def _(spark, folder):
    table = scoring.shuffled_labels(feature_table(spark, folder))
    model = scoring.fit_model(table.filter("split = 'train'"), features.SEQUENCE_FEATURES, features.STATIC_FEATURES)
    scored = model.score(table.filter("split = 'test'")).withColumn("split", F.lit("test"))
    return evaluate.auc_by(scored, ["split"], "prob", "label")
