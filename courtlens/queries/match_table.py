"""Cleaning, orientation and filters of the match table (families A and B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.functions import dates
from courtlens.operators import orient
from courtlens.queries.base import cte, dual, match_table, player_table, query, r6, sql_r6
from courtlens.sources import derived

_ALL_STATS = [f"{s}" for s in orient.STATS]
_DUAL_STATS_SQL = ", ".join(
    f'player_{s} AS "{s}", opp_{s} AS "opponent_{s}"' for s in orient.STATS
)


@query("a02_clean_matches", "matches", """
SELECT tourney_date, match_num, winner_name, loser_name, winner_rank, loser_rank, score FROM matches
WHERE NOT coalesce(regexp_matches(score, 'W/O|RET|DEF'), false)
  AND winner_rank IS NOT NULL AND loser_rank IS NOT NULL
""")
def _(spark, folder):
    return orient.clean_matches(derived.matches(spark, folder)).select(
        "tourney_date", "match_num", "winner_name", "loser_name", "winner_rank", "loser_rank", "score")


@query("a03_served_table", "dual", """
SELECT day AS tourney_date, player, opponent, winner_name, surface, tourney_level, tourney_id, score, round,
  CAST(player_svpt AS DOUBLE) AS player_svpt, CAST(opp_svpt AS DOUBLE) AS opp_svpt FROM dual
""")
def _(spark, folder):
    df = dual(spark, folder, "winner_name", "surface", "tourney_level", "tourney_id", "score", "round")
    return df.select(
        dates.as_date(F.col("tourney_date")).alias("tourney_date"), "player", "opponent", "winner_name", "surface",
        "tourney_level", "tourney_id", "score", "round", F.col("svpt").cast("double").alias("player_svpt"),
        F.col("opponent_svpt").cast("double").alias("opp_svpt"))


@query("b01_two_sided", "dual", f"""
SELECT player, opponent, label, tourney_date, match_num, player_rank, opponent_rank, {_DUAL_STATS_SQL} FROM dual
""")
def _(spark, folder):
    stats = [c for s in orient.STATS for c in (s, f"opponent_{s}")]
    return dual(spark, folder).select(
        "player", "opponent", "label", "tourney_date", "match_num", "player_rank", "opponent_rank", *stats)


@query("b02_collapsed_level", "dual", "SELECT player, match_num, tourney_level FROM dual")
def _(spark, folder):
    return dual(spark, folder, "tourney_level").select("player", "match_num", "tourney_level")


@query("b03_match_key", "dual", "SELECT player, match_num, match_id FROM dual")
def _(spark, folder):
    return dual(spark, folder).select("player", "match_num", "match_id")


@query("b04_int_dates", "", """
SELECT event_id, CAST(year(ts)*10000+month(ts)*100+day(ts) AS INTEGER) AS from_timestamp,
  CAST(year(ts)*10000+month(ts)*100+day(ts) AS INTEGER) AS from_text, CAST(0 AS INTEGER) AS from_bad_text,
  CAST(event_id AS INTEGER) AS from_int
FROM events
""")
def _(spark, folder):
    df = spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("iso"), "event_type")
    kind = {f.name: f.dataType for f in df.schema}
    return df.select(
        "event_id",
        dates.as_int_day(F.col("ts"), kind["ts"]).alias("from_timestamp"),
        dates.as_int_day(F.col("iso"), kind["iso"]).alias("from_text"),
        dates.as_int_day(F.col("event_type"), kind["event_type"]).alias("from_bad_text"),
        dates.as_int_day(F.col("event_id"), kind["event_id"]).alias("from_int"))


@query("b05_match_dates", "dual", """
SELECT player, match_num, day AS match_date, CAST(0 AS INTEGER) AS unreadable FROM dual
""")
def _(spark, folder):
    df = dual(spark, folder)
    day = dates.as_date(F.col("tourney_date"))
    return df.select("player", "match_num", day.alias("match_date"), day.isNull().cast("int").alias("unreadable"))


@query("b06_finished", "matches", """
SELECT match_num, score FROM matches WHERE NOT coalesce(regexp_matches(score, 'W/O|RET|DEF'), false)
""")
def _(spark, folder):
    return orient.finished_only(match_table(spark, folder)).select("match_num", "score")


@query("b07_both_ranked", "matches", """
SELECT match_num, winner_rank, loser_rank FROM matches WHERE winner_rank IS NOT NULL AND loser_rank IS NOT NULL
""")
def _(spark, folder):
    return orient.both_ranked(match_table(spark, folder)).select("match_num", "winner_rank", "loser_rank")


@query("b08_any_service_stat", "matches", f"""
SELECT match_num FROM (SELECT match_num, {", ".join(
    f'CASE WHEN match_num % 31 = 0 THEN NULL ELSE "{side}_{s}" END AS "{side}_{s}"'
    for side in ("w", "l") for s in orient.STATS)} FROM matches)
WHERE coalesce({", ".join(f'"{side}_{s}"' for side in ("w", "l") for s in orient.STATS)}) IS NOT NULL
""")
def _(spark, folder):
    df = match_table(spark, folder)
    blank = {f"{side}_{s}": F.when(F.col("match_num") % 31 != 0, F.col(f"{side}_{s}"))
             for side in ("w", "l") for s in orient.STATS}
    return orient.any_service_stat(df.withColumns(blank)).select("match_num")


_B9 = ["player_ioc", "player_hand", "player_ht", "player_rank", "opponent_rank", "player_svpt", "opponent_svpt",
       "player_1stIn", "opponent_1stIn", "player_1stWon", "opponent_1stWon", "player_2ndWon", "opponent_2ndWon",
       "player_bpSaved", "opponent_bpSaved", "player_bpFaced", "opponent_bpFaced"]


@query("b09_picked_by_name", "dual", """
SELECT player, opponent, match_num, player_ioc, player_hand, player_ht, player_rank, opponent_rank, player_svpt,
  opp_svpt AS opponent_svpt, "player_1stIn", "opp_1stIn" AS "opponent_1stIn", "player_1stWon",
  "opp_1stWon" AS "opponent_1stWon", "player_2ndWon", "opp_2ndWon" AS "opponent_2ndWon", "player_bpSaved",
  "opp_bpSaved" AS "opponent_bpSaved", "player_bpFaced", "opp_bpFaced" AS "opponent_bpFaced" FROM dual
""")
def _(spark, folder):
    raw = match_table(spark, folder)
    return orient.picked_by_name(orient.two_sided(raw)).select("player", "opponent", "match_num", *_B9)


_B10 = [f"{side}_{s}" for side in ("player", "opp") for s in orient.USED_STATS]


@query("b10_player_columns", "dual", f"""
SELECT player, match_num, {", ".join(f'"{c}"' for c in _B10)} FROM dual
""")
def _(spark, folder):
    return player_table(spark, folder).select("player", "match_num", *_B10)


@query("b11_default_columns", "dual", """
SELECT player, match_num, 0.0::DOUBLE AS player_ace, 0.0::DOUBLE AS "opp_bpFaced", 'Hard' AS surface, player_svpt FROM dual
""")
def _(spark, folder):
    df = orient.to_player_columns(dual(spark, folder)).drop("player_ace", "opp_bpFaced")
    return orient.with_base_columns(df).select(
        "player", "match_num", "player_ace", "opp_bpFaced", "surface", "player_svpt")


@query("b13_temporal_split", "dual", """
SELECT player, match_num, tourney_date, CASE WHEN tourney_date <= 19991231 THEN 'train'
  WHEN tourney_date <= 20001231 THEN 'validation' ELSE 'test' END AS split FROM dual
""")
def _(spark, folder):
    return dual(spark, folder).select(
        "player", "match_num", "tourney_date",
        orient.temporal_split(F.col("tourney_date"), 19991231, 20001231).alias("split"))


@query("b14_displayable", "dual", """
SELECT player, match_num, score FROM dual WHERE NOT regexp_matches(score, 'W/O|RET') AND player_svpt > 0 AND opp_svpt > 0
""")
def _(spark, folder):
    return orient.displayable(player_table(spark, folder, "score")).select("player", "match_num", "score")


@query("b15_before_cutoff", "dual", """
SELECT player, match_num, tourney_date FROM dual WHERE tourney_date < 19990301
""")
def _(spark, folder):
    return orient.before_date(dual(spark, folder), 19990301).select("player", "match_num", "tourney_date")


cte("request_rows", ("who", "player_count"), """
SELECT a.name AS player, b.name AS opponent, CAST(20010806 AS INTEGER) AS tourney_date,
  9000000000000000 + a.s_suppkey AS match_num
FROM who a CROSS JOIN player_count JOIN who b ON b.s_suppkey = (a.s_suppkey + 1) % n
""")


def requests(spark, folder):
    """One hypothetical match per pair of neighbouring players."""
    supplier = spark.read.parquet(f"{folder}/supplier.parquet").select("s_suppkey", "s_name")
    total = spark.read.parquet(f"{folder}/supplier.parquet").agg(F.count(F.lit(1))).scalar()
    left = supplier.select(F.col("s_suppkey").alias("a"), F.col("s_name").alias("player"),
                           ((F.col("s_suppkey") + 1) % total).alias("b"))
    right = supplier.select(F.col("s_suppkey").alias("b"), F.col("s_name").alias("opponent"))
    return left.join(right, "b").select(
        "player", "opponent", F.lit(20010806).alias("tourney_date"),
        (F.lit(9000000000000000) + F.col("a")).alias("match_num"))


@query("b16_request_rows", "dual request_rows", """
SELECT player, opponent, tourney_date, match_num, CAST(label AS DOUBLE) AS label, CAST(player_svpt AS DOUBLE) AS player_svpt, false AS is_request FROM dual
UNION ALL SELECT player, opponent, tourney_date, match_num, 0.5, 0.0, true FROM request_rows
""")
def _(spark, folder):
    history = player_table(spark, folder, "winner_name").transform(orient.coerced_history)
    return orient.with_request_rows(history, requests(spark, folder)).select(
        "player", "opponent", "tourney_date", "match_num", "label", "player_svpt", "is_request")


@query("b17_coerced_history", "dual", """
SELECT player, match_num, CASE WHEN player = winner_name THEN 1.0 ELSE 0.0 END::DOUBLE AS label,
  CASE WHEN match_num % 19 = 0 THEN 100.0 ELSE CAST(player_svpt AS DOUBLE) END AS player_svpt,
  CASE WHEN match_num % 23 = 0 THEN 0.0 ELSE CAST(player_ace AS DOUBLE) END AS player_ace,
  coalesce(surface, 'Hard') AS surface FROM dual
""")
def _(spark, folder):
    df = player_table(spark, folder, "winner_name")
    gaps = df.withColumns({
        "player_svpt": F.when(F.col("match_num") % 19 != 0, F.col("player_svpt")),
        "player_ace": F.when(F.col("match_num") % 23 != 0, F.col("player_ace"))})
    return orient.coerced_history(gaps).select("player", "match_num", "label", "player_svpt", "player_ace", "surface")


@query("b18_year_filter", "matches", """
SELECT match_num, tourney_date, CAST(substr(CAST(tourney_date AS VARCHAR),1,4) || '-' || substr(CAST(tourney_date AS VARCHAR),5,2) || '-' || substr(CAST(tourney_date AS VARCHAR),7,2) AS VARCHAR) AS iso
FROM matches WHERE tourney_date // 10000 = 1998
""")
def _(spark, folder):
    df = match_table(spark, folder).select(
        "match_num", "tourney_date", dates.iso_text(F.col("tourney_date")).alias("iso"))
    return df.filter((dates.year_of(F.col("tourney_date")) == 1998) & (F.substring("iso", 1, 4) == "1998"))


@query("b19_no_team_cups", "matches", """
SELECT match_num, tourney_name, tourney_level FROM matches
WHERE tourney_level <> 'D' AND tourney_name NOT LIKE '%United Cup%' AND tourney_name NOT LIKE '%Davis Cup%'
""")
def _(spark, folder):
    from courtlens.operators.views import without_team_cups
    return without_team_cups(match_table(spark, folder)).select("match_num", "tourney_name", "tourney_level")


@query("b23_default_context", "matches", """
SELECT match_num, coalesce(surface, 'Hard') AS surface, coalesce(CASE WHEN match_num % 5 = 0 THEN NULL ELSE round END, 'F') AS round,
  coalesce(CASE WHEN match_num % 3 = 0 THEN NULL ELSE tourney_level END, 'M') AS tourney_level,
  coalesce(CASE WHEN match_num % 13 = 0 THEN NULL ELSE tourney_id END, 'unknown') AS tourney_id,
  coalesce(tourney_name, 'unknown') AS tourney_name FROM matches
""")
def _(spark, folder):
    from courtlens.operators.views import with_default_context
    df = match_table(spark, folder).withColumns({
        "round": F.when(F.col("match_num") % 5 != 0, F.col("round")),
        "tourney_level": F.when(F.col("match_num") % 3 != 0, F.col("tourney_level")),
        "tourney_id": F.when(F.col("match_num") % 13 != 0, F.col("tourney_id"))})
    return with_default_context(df).select("match_num", "surface", "round", "tourney_level", "tourney_id", "tourney_name")


@query("b24_stable_swap", "dual", """
SELECT match_id, match_num, player, CAST((CASE WHEN player < opponent THEN 0 ELSE 1 END
  + CASE WHEN substr(md5(match_id || '/' || match_num || '/42'), 32, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE 0 END) % 2 AS INTEGER) AS slot FROM dual
""")
def _(spark, folder):
    return orient.stable_swap(dual(spark, folder), 42).select("match_id", "match_num", "player", "slot")


@query("g01_sorted_rows", "dual", """
SELECT player, tourney_date, match_num, row_number() OVER (PARTITION BY player ORDER BY tourney_date, match_num) AS position FROM dual
""")
def _(spark, folder):
    from courtlens.operators.windows import career_position
    return career_position(dual(spark, folder)).select("player", "tourney_date", "match_num", "position")


@query("h01_union_sides", "matches", """
SELECT winner_name AS player, count(*) AS n FROM (
  SELECT winner_name FROM matches UNION ALL SELECT loser_name FROM matches) GROUP BY 1
""")
def _(spark, folder):
    df = match_table(spark, folder)
    both = df.select(F.col("winner_name").alias("player")).unionByName(df.select(F.col("loser_name").alias("player")))
    return both.groupBy("player").agg(F.count(F.lit(1)).alias("n"))


@query("h02_first_and_last_per_key", "dual", """
SELECT match_id, min(match_num) AS first_num, max(match_num) AS last_num FROM dual GROUP BY match_id
""")
def _(spark, folder):
    return dual(spark, folder).groupBy("match_id").agg(F.min("match_num").alias("first_num"), F.max("match_num").alias("last_num"))
