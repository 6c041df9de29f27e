"""Requests, rank-free features, stored tables (families A, D11, F28-F32, I12, J12-J13, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.functions import dates, rates
from courtlens.operators import ledger, pasted
from courtlens.operators.joins import ROW_KEYS
from courtlens.plans import bookmaker, features, scoring, serve
from courtlens.queries.base import cte, dual, match_table, player_table, query, r6, rounded, sql_r6
from courtlens.queries.history import rated, served, skilled
from courtlens.queries.ledger import summaries, temperature_table, path, with_odds, PATH
from courtlens.queries.match_table import requests
from courtlens.queries.pasted import typed
from courtlens.queries.scoring import predictions
from courtlens.session import cut_from, cut_lineage, passing
from courtlens.sources import tables


# ---- J12, J13, I12 ------------------------------------------------------------------------------

def request_rows(spark, folder):
    asked = requests(spark, folder)
    surface = F.when(F.col("match_num") % 3 == 0, "Clay").when(F.col("match_num") % 3 == 1, "Grass")
    return asked.withColumn("surface", surface)


def feature_history(spark, folder):
    return cut_lineage(features.match_features(rated(spark, folder), stage=cut_lineage).select(
        "player", "opponent", "tourney_date", "match_num", "label", "surface", *features.ROLLED, *features.SEQUENCE_FEATURES[:6],
        "surface_Hard", "surface_Clay", "surface_Grass", "days_since_last_match", "opp_serve_skill", "opp_return_skill"))


_AFTER = {r: f"avg({r}) OVER (PARTITION BY player ORDER BY tourney_date, match_num ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)" for r in features.ROLLED}
_STEP = "{" + ", ".join(f"'{f}': \"{f}\"" for f in features.SEQUENCE_FEATURES) + "}"
cte("state_after", ("edged",), f"""
SELECT * FROM (SELECT player, tourney_date, match_num, serve_skill, return_skill,
  0.4*{_AFTER['player_1st_win_pct']} + 0.4*{_AFTER['player_2nd_win_pct']} + 0.1*{_AFTER['player_ace_rate']} - 0.1*{_AFTER['player_df_rate']} AS s_after,
  0.5*{_AFTER['player_1st_return_win_pct']} + 0.5*{_AFTER['player_2nd_return_win_pct']} AS r_after,
  list({_STEP}) OVER (PARTITION BY player ORDER BY tourney_date, match_num ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent,
  row_number() OVER (PARTITION BY player ORDER BY tourney_date DESC, match_num DESC) AS back FROM edged WHERE tourney_date < 20010806) WHERE back = 1
""")
cte("served_requests", ("state_after", "request_rows"), """
SELECT q.player, q.opponent, q.match_num, a.recent, a.s_after, a.r_after, coalesce(b.serve_skill, 0.0) AS os, coalesce(b.return_skill, 0.0) AS orr,
  CASE q.match_num % 3 WHEN 0 THEN 'Clay' WHEN 1 THEN 'Grass' ELSE 'Hard' END AS surface
FROM request_rows q LEFT JOIN state_after a ON a.player = q.player LEFT JOIN state_after b ON b.player = q.opponent
""")
_J12 = ["serve_vs_return_edge", "return_vs_serve_edge", "net_edge", "surface_Hard", "surface_Clay", "surface_Grass"]


@query("j12_request_features", "served_requests", """
SELECT player, opponent, round(s_after - orr, 6) + 0.0 AS serve_vs_return_edge, round(r_after - os, 6) + 0.0 AS return_vs_serve_edge, round(s_after - orr + r_after - os, 6) + 0.0 AS net_edge,
  CAST(surface = 'Hard' AS DOUBLE) AS "surface_Hard", CAST(surface = 'Clay' AS DOUBLE) AS "surface_Clay", CAST(surface = 'Grass' AS DOUBLE) AS "surface_Grass",
  CAST(len(recent) AS DOUBLE) AS steps, 'ok' AS status FROM served_requests
""")
def _(spark, folder):
    out = serve.request_features(feature_history(spark, folder), request_rows(spark, folder))
    steps = F.aggregate("mask", F.lit(0.0), lambda a, x: a + x)
    return rounded(out.withColumn("steps", steps), ["player", "opponent", "steps", "status"], _J12)


@query("j13_explained_requests", "served_requests", f"""
SELECT player, opponent, 'sequence' AS part, CAST(i AS INTEGER) AS step, f AS feature, round(CASE f {" ".join(f"WHEN '{f}' THEN recent[i].\"{f}\"" for f in features.SEQUENCE_FEATURES)} END, 6) + 0.0 AS value
FROM served_requests, LATERAL (SELECT unnest(range(1, 11)) AS i), LATERAL (SELECT unnest([{", ".join(f"'{f}'" for f in features.SEQUENCE_FEATURES)}]) AS f)
UNION ALL SELECT player, opponent, 'static', 0, unnest(['serve_vs_return_edge', 'return_vs_serve_edge', 'net_edge', 'surface_Hard', 'surface_Clay', 'surface_Grass']),
  round(unnest([s_after - orr, r_after - os, s_after - orr + r_after - os, CAST(surface = 'Hard' AS DOUBLE), CAST(surface = 'Clay' AS DOUBLE), CAST(surface = 'Grass' AS DOUBLE)]), 6) + 0.0 FROM served_requests
""")
def _(spark, folder):
    out = serve.request_features(feature_history(spark, folder), request_rows(spark, folder))
    return rounded(serve.explained(out), ["player", "opponent", "part", "step", "feature"], ["value"])


@query("j13_history_behind_requests", "recent request_rows", """
SELECT q.player, q.opponent, CAST(11 - r.back AS INTEGER) AS step, r.tourney_date AS date, r.opponent AS faced, r.label = 1 AS won, coalesce(r.surface, 'Hard') AS surface
FROM request_rows q JOIN recent r ON r.player = q.player AND r.back <= 10
""")
def _(spark, folder):
    out = serve.request_features(feature_history(spark, folder), request_rows(spark, folder))
    return serve.explained_history(out)


def custom_rows(spark, folder):
    shown = typed(spark, folder).select(
        "player_name", "opponent", "match_date", "row_index", "surface", "result", "first_in", "first_won", "second_won", "return_pct",
        "break_points_saved", "is_valid")
    newest = pasted.newest_valid(shown, by="player_name").filter("enough")
    counts = pasted.estimated_counts(newest)
    return counts.select(
        F.col("player_name").alias("player"), "opponent", F.date_format("match_date", "yyyyMMdd").cast("int").alias("tourney_date"),
        (-F.col("row_index")).cast("bigint").alias("match_num"), "label", F.nullif(F.col("surface"), F.lit("")).alias("surface"),
        *[f"{side}_{s}" for side in ("player", "opp") for s in ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "bpSaved", "bpFaced")])


@query("i12_overridden_features", "typed_valid request_rows", """
SELECT q.player, q.opponent, coalesce(n >= 10, false) AS override_used, CAST(10 AS DOUBLE) AS steps FROM request_rows q
LEFT JOIN (SELECT player_name, count(*) AS n FROM typed_valid WHERE is_valid GROUP BY 1) c ON c.player_name = q.player
""")
def _(spark, folder):
    history = feature_history(spark, folder)
    frozen = serve.request_features(history, request_rows(spark, folder))
    custom = serve.custom_sequences(cut_lineage(custom_rows(spark, folder)), history)
    out = serve.overridden(frozen, custom)
    return out.select("player", "opponent", "override_used", F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("steps"))


@query("i12_custom_sequence_actuals", "typed_valid", """
SELECT player_name AS player, CAST(11 - recent_no AS INTEGER) AS step, CAST(a AS DOUBLE) AS days_since_last_match FROM (
  SELECT *, row_number() OVER (PARTITION BY player_name ORDER BY match_date DESC, row_index) AS recent_no, count(*) OVER (PARTITION BY player_name) AS n FROM typed_valid WHERE is_valid) x,
  LATERAL (SELECT greatest(0, least(365, coalesce(x.match_date - (SELECT y.match_date FROM (SELECT *, row_number() OVER (PARTITION BY player_name ORDER BY match_date DESC, row_index) AS rn FROM typed_valid WHERE is_valid) y WHERE y.player_name = x.player_name AND y.rn = x.recent_no + 1 AND y.rn <= 10), 0))) AS a)
WHERE recent_no <= 10 AND n >= 10
""")
def _(spark, folder):
    custom = serve.custom_sequences(cut_lineage(custom_rows(spark, folder)), feature_history(spark, folder))
    return custom.select("player", F.posexplode("sequence").alias("i", "x")).select(
        "player", (F.col("i") + 1).alias("step"), r6("x.days_since_last_match").alias("days_since_last_match"))


# ---- D11 ----------------------------------------------------------------------------------------

@query("d11_return_from_opponent_row", "rates", """
SELECT a.player, a.opponent, a.match_num, round(1 - b.serve_pct, 6) + 0.0 AS return_pct FROM rates a JOIN rates b ON b.player = a.opponent AND b.opponent = a.player AND b.match_num = a.match_num
""")
def _(spark, folder):
    df = served(spark, folder).select(*ROW_KEYS, "serve_pct")
    other = df.select(F.col("player").alias("opponent"), F.col("opponent").alias("player"), "tourney_date", "match_num",
                      (1 - F.col("serve_pct")).alias("return_pct"))
    joined = df.join(other, ["player", "opponent", "tourney_date", "match_num"])
    return rounded(joined, ["player", "opponent", "match_num"], ["return_pct"])


# ---- F28-F32 ------------------------------------------------------------------------------------

_P = "PARTITION BY player ORDER BY tourney_date, match_num ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING"


def _asof(values: str, table: str) -> str:
    return (f"{table} a ASOF LEFT JOIN (SELECT player AS who, tourney_date * 10000000000 + match_num AS at, {values} FROM {table}) b "
            "ON a.opponent = b.who AND a.tourney_date * 10000000000 + a.match_num >= b.at")


cte("baselines", ("rates",), f"""
SELECT *, (coalesce(sum(serve_pct) OVER p, 0) + 5 * 0.65) / (count(*) OVER p + 5) AS base_spw, (coalesce(sum(return_pct) OVER p, 0) + 5 * 0.35) / (count(*) OVER p + 5) AS base_rpw,
  count(*) OVER p AS player_matches_last10 FROM rates WINDOW p AS ({_P})
""")
cte("adjusted", ("baselines",), f"""
SELECT a.*, least(greatest(serve_pct - (coalesce(b.brpw, 0.35) - 0.35), 0.5), 0.8)::DOUBLE AS adj_spw, least(greatest(return_pct - (coalesce(b.bspw, 0.65) - 0.65), 0.25), 0.5)::DOUBLE AS adj_rpw,
  coalesce(b.m, 0) AS opponent_matches_last10 FROM {_asof('base_spw AS bspw, base_rpw AS brpw, player_matches_last10 AS m', 'baselines')}
""")


def _ewm_of(v: str, start: float) -> str:
    w = f"list_transform(range(0, len({v})), lambda q: exp(-0.4 * (len({v}) - 1 - q)))"
    return f"CASE WHEN {v} IS NULL OR len({v}) = 0 THEN {start}::DOUBLE ELSE list_dot_product({v}, {w}) / list_sum({w}) END"


cte("recency", ("adjusted",), f"""
SELECT *, {_ewm_of('v1', 0.65)} AS spw_adj_last3, {_ewm_of('v2', 0.65)} AS spw_adj_last10, {_ewm_of('v3', 0.35)} AS rpw_adj_last3, {_ewm_of('v4', 0.35)} AS rpw_adj_last10,
  {_ewm_of('v5', 0.65)} AS spw_adj_last10_surface, {_ewm_of('v6', 0.35)} AS rpw_adj_last10_surface FROM (
  SELECT *, {", ".join(f"list({c}) OVER (PARTITION BY {p} ORDER BY tourney_date, match_num ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS v{i}" for i, (c, n, p) in enumerate([
      ("adj_spw", 3, "player"), ("adj_spw", 10, "player"), ("adj_rpw", 3, "player"), ("adj_rpw", 10, "player"),
      ("adj_spw", 10, "player, coalesce(surface, '')"), ("adj_rpw", 10, "player, coalesce(surface, '')")], 1))} FROM adjusted)
""")


def _baselines(spark, folder):
    return bookmaker.with_baselines(player_table(spark, folder))


def _adjusted(spark, folder):
    return cut_lineage(bookmaker.with_adjusted(_baselines(spark, folder)).select(
        "player", "opponent", "tourney_date", "match_num", "label", "surface", "spw", "rpw", "adj_spw", "adj_rpw", "net_skill",
        "player_matches_last10", "opponent_matches_last10"))


_BID = ["player", "match_num"]


def _recent(spark, folder, *more):
    """Recency means, stored with the columns that are used: bounds of the whole order are sampled
    from them, and sampling would compute the means once more."""
    df = bookmaker.with_recency(_adjusted(spark, folder)).withColumn("rpw_adj_last10", F.round("rpw_adj_last10", 9))
    return cut_lineage(df.select(*_BID, "tourney_date", "rpw_adj_last10", *more))


@query("f28_shrunk_baselines", "baselines", "SELECT player, match_num, round(base_spw, 6) + 0.0 AS base_spw, round(base_rpw, 6) + 0.0 AS base_rpw FROM baselines")
def _(spark, folder):
    return rounded(_baselines(spark, folder), _BID, ["base_spw", "base_rpw"])


@query("f29_adjusted_shares", "adjusted", "SELECT player, match_num, round(adj_spw, 6) + 0.0 AS adj_spw, round(adj_rpw, 6) + 0.0 AS adj_rpw, opponent_matches_last10 FROM adjusted")
def _(spark, folder):
    return rounded(bookmaker.with_adjusted(_baselines(spark, folder)), [*_BID, "opponent_matches_last10"], ["adj_spw", "adj_rpw"])


_F29 = ["spw_adj_last3", "spw_adj_last10", "rpw_adj_last3", "rpw_adj_last10", "spw_adj_last10_surface", "rpw_adj_last10_surface"]


@query("f29_recency_means", "recency", f"SELECT player, match_num, {sql_r6(*_F29)} FROM recency")
def _(spark, folder):
    return rounded(bookmaker.with_recency(_adjusted(spark, folder)), _BID, _F29)


@query("f30_return_buckets", "recency", """
SELECT player, match_num, CAST(ntile(8) OVER (ORDER BY round(rpw_adj_last10, 9), tourney_date, match_num, player) AS INTEGER) AS rpw_bucket_8 FROM recency
""")
def _(spark, folder):
    return bookmaker.with_return_bucket(_recent(spark, folder)).select(*_BID, "rpw_bucket_8")


@query("f31_smoothed_pair_record", "dual", """
SELECT player, match_num, round((w + 1.0) / (n + 2.0), 6) + 0.0 AS h2h_win_pct, CAST(least(n, 10) AS INTEGER) AS h2h_matches_capped FROM (
  SELECT player, match_num, count(*) OVER p AS n, coalesce(sum(label) OVER p, 0) AS w FROM dual WINDOW p AS (PARTITION BY player, opponent ORDER BY tourney_date RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""")
def _(spark, folder):
    return rounded(bookmaker.with_pair_record(dual(spark, folder)), [*_BID, "h2h_matches_capped"], ["h2h_win_pct"])


_F32 = ["player_serve_edge", "opponent_serve_edge", "player_form_edge", "spw_diff_10", "rpw_diff_10", "bookmaker_net_edge", "interaction_product"]
cte("bucketed", ("recency",), "SELECT * REPLACE (round(rpw_adj_last10, 9) AS rpw_adj_last10), CAST(ntile(8) OVER (ORDER BY round(rpw_adj_last10, 9), tourney_date, match_num, player) AS INTEGER) AS rpw_bucket_8 FROM recency")


@query("f32_interactions", "bucketed", f"""
SELECT player, match_num, bucket_diff, {sql_r6(*_F32)} FROM (
  SELECT player, match_num, rpw_bucket_8 - coalesce(ob, rpw_bucket_8) AS bucket_diff, spw_adj_last10 - orr AS player_serve_edge, os - rpw_adj_last10 AS opponent_serve_edge, spw_adj_last3 - spw_adj_last10 AS player_form_edge,
    spw_adj_last10 - os AS spw_diff_10, rpw_adj_last10 - orr AS rpw_diff_10, (spw_adj_last10 - orr) - (os - rpw_adj_last10) AS bookmaker_net_edge, (spw_adj_last10 - orr) * (os - rpw_adj_last10) AS interaction_product
  FROM (SELECT a.*, coalesce(b.s, 0.65) AS os, coalesce(b.r, 0.35) AS orr, b.k AS ob FROM {_asof('spw_adj_last10 AS s, rpw_adj_last10 AS r, rpw_bucket_8 AS k', 'bucketed')}))
""")
def _(spark, folder):
    bucketed = bookmaker.with_return_bucket(_recent(spark, folder, "opponent", "spw_adj_last3", "spw_adj_last10"))
    bucketed = cut_lineage(bucketed)
    return rounded(bookmaker.with_interactions(bucketed), [*_BID, "bucket_diff"], _F32)


# ---- stored tables ------------------------------------------------------------------------------

_RAW = ["tourney_date", "match_num", "winner_name", "loser_name", "winner_rank", "surface", "score", "w_svpt", "l_bpFaced"]


_RAW_SQL = """
SELECT tourney_date, match_num, winner_name, loser_name, winner_rank, surface, score, CAST(w_svpt AS DOUBLE) AS w_svpt, CAST("l_bpFaced" AS DOUBLE) AS "l_bpFaced" FROM matches
"""


@query("a01_raw_csv_a04_written_table", "matches", _RAW_SQL)
def _(spark, folder):
    place = tables.shared_folder(spark, "raw")
    df = match_table(spark, folder)
    df.filter("tourney_date >= 19980101").write.option("header", True).csv(f"{place}/atp_matches_new.csv")
    older = df.filter("tourney_date < 19980101").drop("w_ace", "l_ace")
    older.write.option("header", True).csv(f"{place}/older_years/atp_matches_old.csv")
    stored = tables.shared_folder(spark, "processed")
    tables.write_table(tables.read_raw_matches(spark, place), stored)
    return tables.read_table(spark, stored, _RAW)


@query("a01_merged_file_fallback", "matches", _RAW_SQL)
def _(spark, folder):
    place = tables.shared_folder(spark, "merged")
    match_table(spark, folder).write.option("header", True).csv(f"{place}/merged.csv")
    return tables.read_raw_matches(spark, f"{place}/raw", f"{place}/merged.csv").select(*_RAW)


@query("a04_table_by_year", "matches", "SELECT tourney_date // 10000 AS year, count(*) AS matches, count(winner_rank) AS ranked FROM matches GROUP BY 1")
def _(spark, folder):
    stored = tables.shared_folder(spark, "processed")
    tables.write_table(match_table(spark, folder), stored)
    df = tables.read_table(spark, stored, ["year", "winner_rank"])
    return df.groupBy("year").agg(F.count(F.lit(1)).alias("matches"), F.count("winner_rank").alias("ranked"))


@query("a05_feature_cache", "skilled", "SELECT player, match_num, round(serve_skill, 6) + 0.0 AS serve_skill, round(return_skill, 6) + 0.0 AS return_skill FROM skilled")
def _(spark, folder):
    place = tables.shared_folder(spark, "features")
    names = ["serve_skill", "return_skill"]

    def build():
        return skilled(spark, folder).select("player", "match_num", *names)

    tables.load_or_build_features(spark, place, ["serve_skill"], lambda: build().select("player", "match_num", "serve_skill"))
    tables.load_or_build_features(spark, place, names, build)
    again = tables.load_or_build_features(spark, place, names, build)
    return rounded(again, ["player", "match_num"], names)


@query("a06_written_predictions_a08_read_by_year", "scored", """
SELECT match_num, CAST(substr(CAST(tourney_date AS VARCHAR), 1, 4) || '-' || substr(CAST(tourney_date AS VARCHAR), 5, 2) || '-' || substr(CAST(tourney_date AS VARCHAR), 7, 2) AS VARCHAR) AS date, player_one, player_two,
  round(raw_one, 6) + 0.0 AS prob_one, CASE WHEN actual = 1 THEN 'player_one' ELSE 'player_two' END AS actual_winner FROM scored WHERE tourney_date // 10000 = 1999
""")
def _(spark, folder):
    place = tables.shared_folder(spark, "predictions")
    tables.write_predictions(predictions(spark, folder), place)
    year = tables.read_predictions(spark, place, 1999)
    return year.select("match_num", "date", F.col("player_one.name").alias("player_one"), F.col("player_two.name").alias("player_two"),
                       r6("predicted_probability_player_one").alias("prob_one"), "actual_winner")


@query("a07_newest_prediction_file", "scored", "SELECT count(*) AS rows FROM scored WHERE tourney_date // 10000 = 2000")
def _(spark, folder):
    place = tables.shared_folder(spark, "newest")
    df = predictions(spark, folder).select("match_num", "tourney_date")
    for year in (1999, 2000):
        df.filter(F.floor(F.col("tourney_date") / 10000) == year).write.mode("append").parquet(f"{place}/run={year}")
    newest = tables.newest_run(spark, f"{place}/run=*/*.parquet", "none")
    return spark.read.parquet(newest).agg(F.count(F.lit(1)).alias("rows"))


@query("a10_calibration_parameters", "scored", "SELECT match_num, round(1 / (1 + exp(-ln(raw_one / (1 - raw_one)) / 0.72)), 6) + 0.0 AS prob FROM scored")
def _(spark, folder):
    from courtlens.functions import calibrate
    from courtlens.queries.scoring import combined
    place = tables.shared_folder(spark, "calibration")
    tables.write_calibration(spark, {"method": "temperature", "temperature": 0.72, "platt_a": None, "platt_b": None}, place)
    params = tables.read_calibration(spark, place)
    assert tables.read_calibration(spark, place + "-absent") is None
    value = calibrate.calibrated(F.col("raw_probability"), F.lit(params["method"]), F.lit(params["temperature"]), F.lit(1.0), F.lit(0.0))
    return combined(spark, folder).select("match_num", r6(value).alias("prob"))


@query("a11_exported_reports_a12_read_back", "summaries", "SELECT season, strategy, num_bets_placed, num_total_matches, round(roi_pct, 6) + 0.0 AS roi_pct FROM summaries")
def _(spark, folder):
    return rounded(tables.read_summaries(spark, _reports(spark, folder)), ["season", "strategy", "num_bets_placed", "num_total_matches"], ["roi_pct"])


def _reports(spark, folder):
    place = tables.shared_folder(spark, "reports")
    with passing(spark):
        odds = cut_lineage(with_odds(spark, folder))  # read for the bets, the candidates and the totals
        compared = cut_from(spark, lambda: temperature_table(spark, folder, odds))
        paths = cut_from(spark, lambda: path(spark, folder, odds=odds))  # read for the summaries and for the curves
        tables.export_reports(summaries(spark, folder, paths, odds), compared, ledger.equity_curve(paths, PATH), place)
    return place


@query("a12_comparison_read_back", "temperature_table", f"SELECT season, temperature, bets, {sql_r6('profit', 'roi', 'hit_rate', 'avg_edge', 'max_drawdown')} FROM temperature_table")
def _(spark, folder):
    return rounded(tables.read_temperatures(spark, _reports(spark, folder)), ["season", "temperature", "bets"], ["profit", "roi", "hit_rate", "avg_edge", "max_drawdown"])


@query("a12_equity_read_back", "paths", "SELECT season, strategy, temperature, bet_number, round(bankroll, 6) + 0.0 AS bankroll FROM paths")
def _(spark, folder):
    return rounded(tables.read_equity(spark, _reports(spark, folder)), [*PATH, "bet_number"], ["bankroll"])


@query("a13_stored_scaler", "skilled", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) + 0.0 AS mean, round(stddev_pop({c}), 6) + 0.0 AS std FROM skilled" for c in ("serve_skill", "return_skill")))
def _(spark, folder):
    place = tables.shared_folder(spark, "scaler")
    tables.save_scaler(spark, scoring.fit_static_scaler(skilled(spark, folder), ["serve_skill", "return_skill"]), place)
    return rounded(tables.load_scaler(spark, place).to_frame(spark), ["feature"], ["mean", "std"])


@query("m04_chained_plan", "edged", f"SELECT player, match_num, {sql_r6(*features.SEQUENCE_FEATURES, 'net_edge')} FROM edged")
def _(spark, folder):
    df = player_table(spark, folder).transform(lambda d: features.match_features(d, stage=cut_lineage))
    return rounded(df, ["player", "match_num"], [*features.SEQUENCE_FEATURES, "net_edge"])
