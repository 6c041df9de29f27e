"""Metric documents written to files and read with fallbacks, and column contracts (families A9, B12, E15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.functions import dates
from courtlens.operators import evaluate, orient
from courtlens.queries.base import cte, dual, query, rounded
from courtlens.queries.scoring import VALIDATE_UNTIL, combined, scored_sides
from courtlens.sources import documents, tables

_MEASURES = ["accuracy", "brier", "log_loss", "auc"]


def _measured(rows: str, key: str) -> str:
    """Accuracy, Brier score, log-loss and AUC of (key, s, y) rows."""
    return f"""
SELECT {key}, avg(CAST(CAST(s >= 0.5 AS INTEGER) = y AS DOUBLE)) AS accuracy, avg((s - y) * (s - y)) AS brier,
  avg(-(y * ln(greatest(least(s, 1 - 1e-7), 1e-7)) + (1 - y) * ln(1 - greatest(least(s, 1 - 1e-7), 1e-7)))) AS log_loss,
  (sum(CASE WHEN y = 1 THEN avg_rank ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY {key}, round(s, 9)) - 1) / 2.0 AS avg_rank FROM {rows}) GROUP BY {key}"""


cte("side_scores", ("dual",), """
SELECT CAST(tourney_date // 10000 AS INTEGER) AS year, tourney_date, label AS y, CASE WHEN opponent_rank IS NULL OR player_rank IS NULL THEN 0.5 ELSE 1 / (1 + exp(-(opponent_rank - player_rank) / 50.0)) END AS s FROM dual
""")
cte("match_scores", ("scored",), "SELECT CAST(tourney_date // 10000 AS INTEGER) AS year, tourney_date, actual AS y, raw_one AS s FROM scored")
cte("sample_seasons", ("side_scores",), _measured("side_scores", "year"))
cte("match_seasons", ("match_scores",), _measured("match_scores", "year"))
cte("sample_test", ("side_scores",), _measured(f"(SELECT 1 AS one, * FROM side_scores WHERE tourney_date > {VALIDATE_UNTIL})", "one"))
cte("match_test", ("match_scores",), _measured(f"(SELECT 1 AS one, * FROM match_scores WHERE tourney_date > {VALIDATE_UNTIL})", "one"))


def _measures(df, by, prob, actual):
    ranked = df.withColumn("_score", F.round(prob, 9))  # so that equal rank gaps tie in both engines
    return evaluate.metrics_by(df, by, prob, actual).join(evaluate.auc_by(ranked, by, "_score", actual), by)


def written(spark, folder):
    """Folder of metric documents: seasons as folds, only even seasons with figures per match, and
    three runs of which one has figures per match, one only per sample and one none."""
    year = dates.year_of(F.col("tourney_date"))
    sides = scored_sides(spark, folder).withColumn("year", year)
    matches = evaluate.as_predictions(combined(spark, folder)).withColumn("year", year)
    per_match = _measures(matches, ["year"], "prob_one", "actual").select("year", F.col("accuracy").alias("match_accuracy"))
    seasons = _measures(sides, ["year"], "prob", "label").join(per_match.where("year % 2 = 0"), "year", "left")
    folds = seasons.select(
        F.concat(F.lit("season_"), F.col("year").cast("string")).alias("name"), F.col("year").cast("string").alias("description"),
        F.when(F.col("year") % 3 != 0, F.concat(F.col("year").cast("string"), F.lit("1231"))).otherwise("").alias("val_cutoff"),
        "accuracy", "match_accuracy", "auc", "log_loss")
    late = F.col("tourney_date") > VALIDATE_UNTIL
    sample = _measures(sides.where(late).withColumn("one", F.lit(1)), ["one"], "prob", "label").select("one", *_MEASURES)
    match = _measures(matches.where(late).withColumn("one", F.lit(1)), ["one"], "prob_one", "actual").select(
        "one", *[F.col(m).alias(f"match_{m}") for m in _MEASURES])
    fields = [*_MEASURES, *[f"match_{m}" for m in _MEASURES]]
    figures = sample.join(match, "one")
    runs = figures.select(F.lit("per_match").alias("run"), F.struct(*fields).alias("test"))
    for run, kept in (("per_sample", _MEASURES), ("none", [])):
        test = F.struct(*[(F.col(f) if f in kept else F.lit(None).cast("double")).alias(f) for f in fields])
        runs = runs.unionByName(figures.select(F.lit(run).alias("run"), test.alias("test")))
    place = tables.shared_folder(spark, "metrics")
    documents.write_metric_documents(folds, runs, place)
    return place


@query("a09_test_metrics_of_documents", "sample_test match_test", " UNION ALL ".join(
    f"SELECT '{run}' AS run, " + ", ".join(f"{f'round({m}, 6) + 0.0' if table else '0.0::DOUBLE'} AS {m}" for m in _MEASURES) + f" FROM {table or 'sample_test'}"
    for run, table in (("per_match", "match_test"), ("per_sample", "sample_test"), ("none", ""))))
def _(spark, folder):
    return rounded(documents.test_metrics(documents.read_run_documents(spark, f"{written(spark, folder)}/runs")), ["run"], _MEASURES)


@query("e15_series_of_documents_a09", "sample_seasons match_seasons", """
SELECT 'loss_history' AS series, 'season_' || year AS label, round(log_loss, 6) + 0.0 AS value FROM sample_seasons
UNION ALL SELECT 'auc_history', 'season_' || year, round(auc, 6) + 0.0 FROM sample_seasons
UNION ALL SELECT 'seasonal_stability', CASE WHEN year % 3 <> 0 THEN CAST(year AS VARCHAR) ELSE 'season_' || year END, round(CASE WHEN year % 2 = 0 THEN m.accuracy ELSE s.accuracy END, 6) + 0.0
FROM sample_seasons s JOIN match_seasons m USING (year)
""")
def _(spark, folder):
    return rounded(documents.series(documents.read_metric_documents(spark, f"{written(spark, folder)}/folds")), ["series", "label"], ["value"])


@query("e15_summary_of_documents_a09", "sample_seasons match_seasons", """
SELECT round(avg(a), 6) + 0.0 AS val_accuracy_mean, round(stddev_pop(a), 6) + 0.0 AS val_accuracy_std, round(avg(auc), 6) + 0.0 AS val_auc_mean
FROM (SELECT CASE WHEN year % 2 = 0 THEN m.accuracy ELSE s.accuracy END AS a, s.auc AS auc FROM sample_seasons s JOIN match_seasons m USING (year))
""")
def _(spark, folder):
    document = documents.read_metric_documents(spark, f"{written(spark, folder)}/folds")
    return rounded(document.select("summary.*"), [], ["val_accuracy_mean", "val_accuracy_std", "val_auc_mean"])


# Columns that building sequences needs, by type; the last four only without ranks.
SEQUENCE_COLUMNS = {
    "player": "string", "opponent": "string", "match_id": "string", "tourney_date": "int", "label": "int", "1stWon": "bigint", "2ndWon": "bigint",
    "svpt": "bigint", "opponent_1stWon": "bigint", "opponent_2ndWon": "bigint", "opponent_svpt": "bigint", "surface": "string", "tourney_level": "string",
    "round": "string", "opponent_rank": "double", "opp_return_strength": "double", "adj_spw": "double", "adj_rpw": "double", "net_skill": "double"}
_HELD = {"1stWon": "player_1stWon", "2ndWon": "player_2ndWon", "svpt": "player_svpt", "opponent_1stWon": "opp_1stWon", "opponent_2ndWon": "opp_2ndWon", "opponent_svpt": "opp_svpt"}
_ABSENT = ("opp_return_strength", "adj_spw", "adj_rpw", "net_skill")


@query("b12_required_columns", "dual", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {str(c not in _ABSENT).lower()} AS present, {str(c not in _ABSENT).lower()} AS fits, " + (
        "count(NULL)" if c in _ABSENT else f'count("{_HELD.get(c, c)}")') + " AS filled FROM dual" for c in SEQUENCE_COLUMNS))
def _(spark, folder):
    table = dual(spark, folder, "surface", "tourney_level", "round")
    return orient.column_contract(table, SEQUENCE_COLUMNS).select("column", "present", "fits", "filled")
