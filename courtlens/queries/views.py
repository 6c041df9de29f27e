"""Player, pair and tournament views (families B20-B22, C5, C19, C32-C38, D4-D16, E1-E5, E12-E25, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.functions import categories, dates, names, rates, ranks
from courtlens.operators import evaluate, views
from courtlens.operators.timeline import newest, one_per_key
from courtlens.queries.base import cte, dual, match_table, player_table, query, r6, rounded, sql_r6

_PM = ["player", "match_num"]


def shown(spark, folder, *carry):
    """Displayable rows with shares and adjusted values."""
    return views.recent_match_rows(player_table(spark, folder, "score", *carry))


cte("shown", ("rates",), """
SELECT *, serve_pct - (player_svpt - player_1stWon - player_2ndWon) / CAST(player_svpt AS DOUBLE) AS adjusted_serve,
  return_pct - (opp_1stWon + opp_2ndWon) / CAST(opp_svpt AS DOUBLE) AS adjusted_return,
  row_number() OVER (PARTITION BY player ORDER BY tourney_date DESC, match_num DESC) AS back
FROM rates WHERE NOT regexp_matches(score, 'W/O|RET') AND player_svpt > 0 AND opp_svpt > 0
""")
cte("pairs", ("who", "player_count"), """
SELECT a.name AS player_one, b.name AS player_two FROM who a CROSS JOIN player_count
JOIN who b ON b.s_suppkey = (a.s_suppkey + 1) % n
""")


def pairs(spark, folder):
    """One requested pair per player: the next one in key order."""
    from courtlens.queries.match_table import requests
    return requests(spark, folder).select(F.col("player").alias("player_one"), F.col("opponent").alias("player_two"))


# ---- single rows -------------------------------------------------------------------------------

@query("c05_opponent_adjusted", "shown", f"SELECT player, match_num, {sql_r6('adjusted_serve', 'adjusted_return')} FROM shown")
def _(spark, folder):
    return rounded(shown(spark, folder), _PM, ["adjusted_serve", "adjusted_return"])


@query("c36_opponent_effect", "shown", """
SELECT player, match_num, round((serve_pct - adjusted_serve) * 100, 6) + 0.0 AS serve_effect, round((return_pct - adjusted_return) * 100, 6) + 0.0 AS return_effect FROM shown
""")
def _(spark, folder):
    df = shown(spark, folder)
    return df.select(*_PM, r6((F.col("serve_pct") - F.col("adjusted_serve")) * 100).alias("serve_effect"),
                     r6((F.col("return_pct") - F.col("adjusted_return")) * 100).alias("return_effect"))


@query("c19_slugs", "", """
SELECT p_partkey, regexp_replace(regexp_replace(translate(lower(trim(p_name)), '%s', '%s'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part
""" % (names.ACCENTED, names.PLAIN))
def _(spark, folder):
    return spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", names.slug(F.col("p_name")).alias("slug"))


@query("c19_slugs_of_texts", "", """
SELECT doc_id, regexp_replace(regexp_replace(translate(lower(trim(text)), '%s', '%s'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM documents
""" % (names.ACCENTED, names.PLAIN))
def _(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select("doc_id", names.slug(F.col("text")).alias("slug"))


@query("c30_surname_order", "", """
SELECT a.p_partkey, CASE WHEN sa > sb OR (sa = sb AND a.p_name > b.p_name) THEN b.p_name ELSE a.p_name END AS player_one,
  CASE WHEN sa > sb OR (sa = sb AND a.p_name > b.p_name) THEN a.p_name ELSE b.p_name END AS player_two
FROM (SELECT *, lower(regexp_extract(trim(p_name), '[^ ]+$')) AS sa FROM part) a
JOIN (SELECT *, lower(regexp_extract(trim(p_name), '[^ ]+$')) AS sb FROM part) b ON b.p_partkey = (a.p_partkey + 1) % (SELECT count(*) FROM part)
""")
def _(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name")
    total = part.agg(F.count(F.lit(1))).scalar()
    left = part.withColumn("next", (F.col("p_partkey") + 1) % total)
    right = part.select(F.col("p_partkey").alias("next"), F.col("p_name").alias("other"))
    one, two = names.by_surname(F.col("p_name"), F.col("other"))
    return left.join(right, "next").select("p_partkey", one.alias("player_one"), two.alias("player_two"))


@query("c31_iso_dates", "dual", """
SELECT player, match_num, strftime(day, '%Y-%m-%d') AS iso, strftime(day, '%Y-%m') AS year_month, CAST(year(day) AS INTEGER) AS year FROM dual
""")
def _(spark, folder):
    d = F.col("tourney_date")
    return dual(spark, folder).select(
        *_PM, dates.iso_text(d).alias("iso"), dates.year_month(d).alias("year_month"), dates.year_of(d).alias("year"))


@query("c32_rank_bonus", "dual", """
SELECT player, match_num, round(CASE WHEN player_rank IS NULL OR opponent_rank IS NULL THEN 0.0 WHEN label = 1 THEN
  CASE WHEN opponent_rank <= 5 THEN 0.02 WHEN opponent_rank <= 10 THEN 0.015 WHEN opponent_rank <= 20 THEN 0.01 WHEN opponent_rank <= 50 THEN 0.005
    WHEN opponent_rank <= 100 THEN 0.0025 ELSE greatest(0.0, -0.0025 * (opponent_rank - 100) / 100) END
  ELSE CASE WHEN opponent_rank > 100 THEN -0.02 WHEN opponent_rank > 50 THEN -0.015 WHEN opponent_rank > 20 THEN -0.01 WHEN opponent_rank > 10 THEN -0.005
    WHEN opponent_rank > 5 THEN -0.0025 ELSE 0.0 END END::DOUBLE, 6) + 0.0 AS bonus FROM dual
""")
def _(spark, folder):
    value = ranks.rank_bonus(F.col("player_rank"), F.col("opponent_rank"), F.col("label") == 1)
    return dual(spark, folder).select(*_PM, r6(value).alias("bonus"))


@query("c33_event_tiers", "matches", """
SELECT match_num, CASE WHEN tourney_name LIKE '%250%' THEN '250' WHEN tourney_name LIKE '%500%' THEN '500' WHEN tourney_name LIKE '%Masters%' THEN 'M'
  WHEN regexp_matches(tourney_name, 'Grand Slam|Australian Open|French Open|Wimbledon|US Open') THEN 'G' ELSE 'M' END AS tier,
  CASE WHEN regexp_matches(tourney_name, 'Australian Open|French Open|Wimbledon|US Open') THEN 'Grand Slam' WHEN tourney_name LIKE '%ATP250%' THEN 'ATP250'
  WHEN tourney_name LIKE '%ATP500%' THEN 'ATP500' WHEN tourney_name LIKE '%ATP1000%' THEN 'ATP1000' END AS tier_group,
  CASE WHEN tourney_name LIKE '%Challenger%' THEN 'C' WHEN tourney_name LIKE '%Davis Cup%' THEN 'D' WHEN regexp_matches(tourney_name, 'ATP Cup|United Cup') THEN 'A'
  WHEN regexp_matches(tourney_name, 'Tour Finals|ATP Finals') THEN 'F' WHEN regexp_matches(tourney_name, 'Australian Open|French Open|Roland Garros|Wimbledon|US Open') THEN 'G'
  WHEN regexp_matches(tourney_name, 'Miami|Indian Wells|Monte Carlo|Madrid|Rome|Toronto|Cincinnati|Shanghai|Paris Masters') THEN 'M'
  WHEN regexp_matches(tourney_name, 'Dubai|Barcelona|Hamburg|Washington|Beijing|Vienna|Basel') THEN '500' ELSE '250' END AS level FROM matches
""")
def _(spark, folder):
    name = F.col("tourney_name")
    return match_table(spark, folder).select(
        "match_num", categories.tier_from_event(name).alias("tier"), categories.tier_group(name).alias("tier_group"),
        categories.level_from_event(name).alias("level"))


@query("c34_rank_transforms", "dual", """
SELECT player, match_num, round(1.0 / coalesce(opponent_rank, 1000.0), 6) + 0.0 AS inverse_rank,
  round(CASE WHEN opponent_rank <= 1000 AND opponent_rank <> 0 THEN 1.0 / (1.0 + opponent_rank) END, 6) + 0.0 AS normalised_rank,
  CASE WHEN coalesce(opponent_rank, 1000.0) <= 100 THEN 100.0 - opponent_rank ELSE 0.0 END AS difficulty,
  CASE WHEN coalesce(opponent_rank, 999.0) = 999 THEN 0.0 ELSE 200.0 - opponent_rank END AS inverted_axis FROM dual
""")
def _(spark, folder):
    rank = F.col("opponent_rank")
    return dual(spark, folder).select(
        *_PM, r6(ranks.inverse_rank(rank)).alias("inverse_rank"), r6(ranks.normalised_rank(rank)).alias("normalised_rank"),
        ranks.difficulty(rank).alias("difficulty"), ranks.inverted_axis(rank).alias("inverted_axis"))


@query("c35_combined_performance", "shown", """
SELECT player, match_num, round(CASE WHEN serve_pct <> 0 AND return_pct <> 0 THEN (serve_pct + return_pct) / 2 * 100 END, 6) + 0.0 AS combined,
  round((serve_pct + return_pct) / 2 * (1.0 / coalesce(opponent_rank, 1000.0)) * 100, 6) + 0.0 AS rank_weighted FROM shown
""")
def _(spark, folder):
    df = shown(spark, folder)
    mean = (F.col("serve_pct") + F.col("return_pct")) / 2
    both = (F.col("serve_pct") != 0) & (F.col("return_pct") != 0)
    return df.select(*_PM, r6(F.when(both, mean * 100)).alias("combined"),
                     r6(mean * ranks.inverse_rank(F.col("opponent_rank")) * 100).alias("rank_weighted"))


_RANGES = (("days_since_prev", 0.0, 365.0, True), ("serve_pct", 0.3, 0.9, False), ("return_pct", 0.1, 0.6, False),
           ("opponent_rank", 1.0, 1.0, False))


@query("c38_min_max", "steps_in", f"""
SELECT player, match_num, feature, round(CASE WHEN lo = hi THEN 0.5 ELSE greatest(0.0, least(1.0, CASE WHEN inv THEN 1 - (v - lo) / (hi - lo) ELSE (v - lo) / (hi - lo) END)) END, 6) + 0.0 AS value
FROM (SELECT player, match_num, unnest(['days_since_prev', 'serve_pct', 'return_pct', 'opponent_rank']) AS feature,
  unnest([days_since_prev, serve_pct, return_pct, coalesce(opponent_rank, 0.0)]) AS v FROM steps_in)
JOIN (VALUES {", ".join(f"('{n}', {lo}, {hi}, {str(inv).lower()})" for n, lo, hi, inv in _RANGES)}) r(name, lo, hi, inv) ON feature = name
""")
def _(spark, folder):
    from courtlens.operators import windows
    df = windows.days_since_previous(player_table(spark, folder)).withColumns({
        "serve_pct": rates.serve_pct("player"), "return_pct": rates.return_pct("opp")})
    return evaluate.min_max_long(df, _PM, _RANGES).select(*_PM, "feature", r6("value").alias("value"))


@query("c39_feature_names", "", """
SELECT name, CASE WHEN name = 'net_edge' THEN 'Net Edge' WHEN name = 'streak' THEN 'Current Win Streak' ELSE 'Supplier#' || substr(name, 10) END AS display_name,
  CASE WHEN name = 'net_edge' THEN 'Matchup Edge' ELSE 'Other' END AS category
FROM (SELECT 'supplier#' || substr(s_name, 10) AS name FROM supplier UNION SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'net_edge' ELSE 'streak' END FROM supplier)
""")
def _(spark, folder):
    sup = spark.read.parquet(f"{folder}/supplier.parquet")
    named = sup.select(F.concat(F.lit("supplier#"), F.expr("substr(s_name, 10)")).alias("name")).unionByName(
        sup.select(F.when(F.col("s_suppkey") % 2 == 0, "net_edge").otherwise("streak").alias("name"))).distinct()
    return named.select("name", categories.display_name(F.col("name")).alias("display_name"),
                        categories.feature_category(F.col("name")).alias("category"))


# ---- players -----------------------------------------------------------------------------------

cte("records", ("dual",), """
SELECT regexp_replace(lower(player), '[^a-z0-9]+', '-', 'g') AS slug, player AS name, player_ioc AS country, player_hand AS handedness,
  CAST(player_ht AS INTEGER) AS height_cm, CAST(player_rank AS INTEGER) AS last_rank, day AS last_rank_date
FROM dual QUALIFY row_number() OVER (PARTITION BY player ORDER BY tourney_date DESC, match_num DESC) = 1
""")


def records(spark, folder):
    from courtlens.operators import orient
    raw = match_table(spark, folder)
    keep = ["tourney_date", "match_num", "winner_name", "winner_ioc", "loser_ioc", "winner_hand", "loser_hand",
            "winner_ht", "loser_ht"]
    sided = orient.two_sided(raw, keep)
    won = F.col("player") == F.col("winner_name")
    profile = {f"player_{c}": F.when(won, F.col(f"winner_{c}")).otherwise(F.col(f"loser_{c}")) for c in ("ioc", "hand", "ht")}
    return views.latest_player_records(sided.withColumns(profile))


@query("e01_latest_player_records", "records", "SELECT * FROM records")
def _(spark, folder):
    return records(spark, folder)


@query("b21_player_search", "records", """
SELECT * FROM records WHERE contains(lower(name), '#00000000') ORDER BY coalesce(nullif(last_rank, 0), 9999), name LIMIT 10
""")
def _(spark, folder):
    return views.search_players(records(spark, folder), "#00000000", 10)


@query("b22_player_by_slug", "records", "SELECT * FROM records WHERE slug = 'supplier-000000003'")
def _(spark, folder):
    return views.player_by_slug(records(spark, folder), "supplier-000000003")


@query("g04_top_players", "records", "SELECT name, last_rank FROM records ORDER BY coalesce(nullif(last_rank, 0), 9999), name LIMIT 5")
def _(spark, folder):
    return views.search_players(records(spark, folder), None, 5).select("name", "last_rank")


cte("story", ("rates",), """
SELECT a.player, better_ranked_share, mean_opponent_rank, serve_spread, coalesce(l, 0.0) AS level_better_ranked_share FROM (
  SELECT player, avg(coalesce(CAST(player_rank < opponent_rank AS DOUBLE), 0.0)) AS better_ranked_share, avg(opponent_rank) AS mean_opponent_rank,
    stddev_pop(serve_pct) AS serve_spread
  FROM (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY player ORDER BY tourney_date DESC, match_num DESC) <= 10) GROUP BY player) a
LEFT JOIN (SELECT player, avg(coalesce(CAST(player_rank < opponent_rank AS DOUBLE), 0.0)) AS l FROM rates WHERE tourney_level = 'M' GROUP BY player) b ON a.player = b.player
""")


@query("e05_pair_story", "story pairs", """
SELECT player_one, player_two, label, round(CASE i WHEN 1 THEN a.better_ranked_share WHEN 2 THEN a.level_better_ranked_share WHEN 3 THEN a.mean_opponent_rank ELSE a.serve_spread END, 6) + 0.0 AS player_one_value,
  round(CASE i WHEN 1 THEN b.better_ranked_share WHEN 2 THEN b.level_better_ranked_share WHEN 3 THEN b.mean_opponent_rank ELSE b.serve_spread END, 6) + 0.0 AS player_two_value, unit
FROM pairs JOIN story a ON a.player = player_one JOIN story b ON b.player = player_two
CROSS JOIN (VALUES (1, 'Rolling form (last 10)', 'win %'), (2, 'Masters win %', 'win %'), (3, 'Avg opponent rank (10 matches)', 'rank'), (4, 'Serve consistency index', 'std')) t(i, label, unit)
""")
def _(spark, folder):
    df = player_table(spark, folder, "tourney_level")
    return rounded(views.pair_story(df, pairs(spark, folder)), ["player_one", "player_two", "label", "unit"],
                   ["player_one_value", "player_two_value"])


_E20 = ["win_rate", "serve_avg", "return_avg", "opponent_quality", "top10_wins"]


@query("e20_form_profile", "shown", """
SELECT player, round(avg(CAST(label AS DOUBLE)) * 100, 6) + 0.0 AS win_rate, round(avg(serve_pct) * 100, 6) + 0.0 AS serve_avg, round(avg(return_pct) * 100, 6) + 0.0 AS return_avg,
  round(greatest(0.0, 100 - avg(coalesce(nullif(opponent_rank, 0), 1000.0)) / 20), 6) + 0.0 AS opponent_quality,
  round(CAST(count(*) FILTER (WHERE label = 1 AND coalesce(opponent_rank, 1000) <= 10) AS DOUBLE) / greatest(count(*) FILTER (WHERE coalesce(opponent_rank, 1000) <= 10), 1) * 100, 6) + 0.0 AS top10_wins
FROM shown WHERE back <= 10 GROUP BY player
""")
def _(spark, folder):
    return rounded(views.form_profile(shown(spark, folder)), ["player"], _E20)


_E21 = ["min", "q1", "median", "q3", "max", "mean", "std_dev"]


@query("e21_serve_box_plot", "shown", """
SELECT player, round(v[1], 6) + 0.0 AS min, round(v[CAST(floor(len(v) * 0.25) AS BIGINT) + 1], 6) + 0.0 AS q1, round(v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1], 6) + 0.0 AS median,
  round(v[CAST(floor(len(v) * 0.75) AS BIGINT) + 1], 6) + 0.0 AS q3, round(v[-1], 6) + 0.0 AS max, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS std_dev
FROM (SELECT player, list(serve_pct ORDER BY serve_pct) AS v, avg(serve_pct) AS mean, stddev_pop(serve_pct) AS sd FROM shown WHERE back <= 10 GROUP BY player)
""")
def _(spark, folder):
    return rounded(views.box_plot(shown(spark, folder), "serve_pct"), ["player"], _E21)


@query("e23_mean_normalised_rank", "shown", """
SELECT player, round(avg(CASE WHEN opponent_rank <= 1000 THEN 1.0 / (1.0 + opponent_rank) END), 6) + 0.0 AS mean_normalised_rank FROM shown WHERE back <= 10 GROUP BY player
""")
def _(spark, folder):
    last = newest(shown(spark, folder), ["player"], ["tourney_date", "match_num"], 10)
    return last.groupBy("player").agg(r6(F.avg(ranks.normalised_rank(F.col("opponent_rank")))).alias("mean_normalised_rank"))


# ---- win shares --------------------------------------------------------------------------------

_SHARE = "count(*) AS matches, CAST(sum(label) AS BIGINT) AS wins, round(avg(CAST(label AS DOUBLE)) * 100, 6) + 0.0 AS win_pct"


def _share(df, *keys, more=()):
    return rounded(df, [*keys, "matches", "wins"], ["win_pct", *more])


@query("e16_by_surface", "rates", f"""
SELECT player, surface, {_SHARE}, round(avg(serve_pct) * 100, 6) + 0.0 AS serve_avg FROM rates WHERE surface IN ('Hard','Clay','Grass') GROUP BY 1, 2
""")
def _(spark, folder):
    df = player_table(spark, folder).withColumn("serve_pct", rates.serve_pct("player"))
    return _share(views.by_surface(df), "player", "surface", more=["serve_avg"])


def _bucket_sql(buckets, unranked=None) -> str:
    cases = []
    for name, low, high in buckets:
        cond = " AND ".join(([f"opponent_rank >= {low}"] if low is not None else []) + ([f"opponent_rank <= {high}"] if high is not None else [])) or "true"
        cases.append(f"WHEN {cond} THEN '{name}'")
    missing = f"'{unranked}'" if unranked else "NULL"
    return f"CASE WHEN opponent_rank IS NULL OR opponent_rank = 0 THEN {missing} {' '.join(cases)} END"


for _name, _buckets, _unranked in (
    ("e17_rank_buckets_five", ranks.BUCKETS_FIVE, None), ("e17_rank_buckets_six", ranks.BUCKETS_SIX, None),
    ("e17_rank_buckets_quality", ranks.BUCKETS_QUALITY, "Unranked"),
):
    def _make(buckets=_buckets, unranked=_unranked):
        return lambda spark, folder: _share(views.by_rank_bucket(dual(spark, folder), buckets, unranked), "player", "bucket")

    query(_name, "dual", f"""
SELECT player, bucket, {_SHARE} FROM (SELECT *, {_bucket_sql(_buckets, _unranked)} AS bucket FROM dual) WHERE bucket IS NOT NULL GROUP BY 1, 2
""")(_make())


@query("e17_recent_and_career_buckets", "dual", f"""
WITH b AS (SELECT *, {_bucket_sql(ranks.BUCKETS_FIVE_WIDE)} AS bucket, row_number() OVER (PARTITION BY player ORDER BY tourney_date DESC, match_num DESC) AS back FROM dual)
SELECT player, bucket, round(avg(CAST(label AS DOUBLE)) * 100, 6) + 0.0 AS career_win_pct, round(avg(CASE WHEN back <= 10 THEN CAST(label AS DOUBLE) END) * 100, 6) + 0.0 AS recent_win_pct
FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2
""")
def _(spark, folder):
    return rounded(views.recent_and_career(dual(spark, folder), ranks.BUCKETS_FIVE_WIDE), ["player", "bucket"],
                   ["career_win_pct", "recent_win_pct"])


for _name, _rounds, _surface in (
    ("e18_by_round", categories.DRAW_ROUNDS, None), ("e18_by_late_round", categories.LATE_ROUNDS, None),
    ("e18_by_round_hard", categories.NUMBERED_ROUNDS, "Hard"),
):
    def _make_round(rounds=_rounds, surface=_surface):
        return lambda spark, folder: _share(views.by_round(dual(spark, folder, "round", "surface"), rounds, surface), "player", "round")

    query(_name, "dual", f"""
SELECT player, round, {_SHARE.replace('round(avg', 'round(avg')} FROM dual WHERE "round" IN ({", ".join(f"'{r}'" for r in _rounds)})
{f"AND surface = '{_surface}'" if _surface else ""} GROUP BY 1, 2
""")(_make_round())


@query("e19_by_tier", "dual", f"""
SELECT player, tier, {_SHARE} FROM (SELECT *, CASE WHEN regexp_matches(tourney_name, 'Australian Open|French Open|Wimbledon|US Open') THEN 'Grand Slam'
  WHEN tourney_name LIKE '%ATP250%' THEN 'ATP250' WHEN tourney_name LIKE '%ATP500%' THEN 'ATP500' WHEN tourney_name LIKE '%ATP1000%' THEN 'ATP1000' END AS tier FROM dual)
WHERE tier IS NOT NULL GROUP BY 1, 2
""")
def _(spark, folder):
    return _share(views.by_tier(dual(spark, folder, "tourney_name")), "player", "tier")


cte("tier_counts", ("dual",), """
SELECT player, tier, count(*) AS matches FROM (SELECT player, CASE WHEN tourney_name LIKE '%250%' THEN '250' WHEN tourney_name LIKE '%500%' THEN '500'
  WHEN tourney_name LIKE '%Masters%' THEN 'M' WHEN regexp_matches(tourney_name, 'Grand Slam|Australian Open|French Open|Wimbledon|US Open') THEN 'G' ELSE 'M' END AS tier FROM dual) GROUP BY 1, 2
""")


@query("e19_tier_counts", "tier_counts", """
SELECT player, tier, matches, CASE tier WHEN '250' THEN 'ATP 250' WHEN '500' THEN 'ATP 500' WHEN 'M' THEN 'Masters 1000' ELSE 'Grand Slam' END AS tier_name FROM tier_counts
""")
def _(spark, folder):
    return views.tier_counts(dual(spark, folder, "tourney_name"))


@query("h03_tier_union_of_pair", "tier_counts pairs", """
SELECT player_one, player_two, tier, CAST(sum(CASE WHEN c.player = player_one THEN matches ELSE 0 END) AS BIGINT) AS player_one_matches,
  CAST(sum(CASE WHEN c.player = player_two THEN matches ELSE 0 END) AS BIGINT) AS player_two_matches
FROM pairs JOIN tier_counts c ON c.player IN (player_one, player_two) GROUP BY 1, 2, 3
""")
def _(spark, folder):
    return views.tier_union(views.tier_counts(dual(spark, folder, "tourney_name")), pairs(spark, folder))


@query("e29_higher_rank_baseline", "matches", """
SELECT count(*) AS matches, round(avg(CAST(winner_rank < loser_rank AS DOUBLE)), 6) + 0.0 AS accuracy FROM matches WHERE winner_rank IS NOT NULL AND loser_rank IS NOT NULL
""")
def _(spark, folder):
    return evaluate.higher_rank_baseline(match_table(spark, folder)).select("matches", r6("accuracy").alias("accuracy"))


# ---- pairs -------------------------------------------------------------------------------------

cte("met", ("dual",), """
SELECT least(player, opponent) AS player_one, greatest(player, opponent) AS player_two, match_id, tourney_date, match_num, tourney_name, surface, round, score, winner_name AS winner,
  CAST(winner_name = least(player, opponent) AS INTEGER) AS player_one_win
FROM dual WHERE tourney_date >= 19980101 AND NOT regexp_matches(lower(coalesce(score, '')), 'w/o|ret')
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY tourney_date DESC, match_num DESC, player) = 1
""")


def met(spark, folder):
    df = dual(spark, folder, "winner_name", "surface", "round", "score", "tourney_name")
    return views.meetings(df, since=19980101)


@query("d07_pair_meetings", "met", "SELECT player_one, player_two, match_id, match_num FROM met")
def _(spark, folder):
    return met(spark, folder).select("player_one", "player_two", "match_id", "match_num")


@query("e02_head_to_head", "met", """
SELECT player_one, player_two, count(*) AS total_matches, CAST(sum(player_one_win) AS BIGINT) AS player_one_wins, CAST(sum(1 - player_one_win) AS BIGINT) AS player_two_wins FROM met GROUP BY 1, 2
""")
def _(spark, folder):
    return views.head_to_head(met(spark, folder))


@query("e03_head_to_head_by_surface", "met", """
SELECT player_one, player_two, surface, CAST(sum(player_one_win) AS DOUBLE) AS player_one_value, CAST(sum(1 - player_one_win) AS DOUBLE) AS player_two_value
FROM met WHERE surface IS NOT NULL GROUP BY 1, 2, 3
""")
def _(spark, folder):
    return views.head_to_head_by_surface(met(spark, folder))


@query("e04_meetings_newest_first", "met", """
SELECT player_one, player_two, strptime(CAST(tourney_date AS VARCHAR), '%Y%m%d')::DATE AS date, match_num, tourney_name AS tournament, surface, round, winner, score FROM met
""")
def _(spark, folder):
    rows = met(spark, folder).select(
        "player_one", "player_two", dates.as_date(F.col("tourney_date")).alias("date"), "match_num",
        F.col("tourney_name").alias("tournament"), "surface", "round", F.col("winner_name").alias("winner"), "score")
    return rows.orderBy("player_one", "player_two", F.col("date").desc(), F.col("match_num").desc())


_D8 = """
SELECT player_one, player_two, player_one > player_two AS swapped, match_id, tourney_date, match_num FROM pairs
JOIN dual ON player = least(player_one, player_two) AND opponent = greatest(player_one, player_two)
QUALIFY row_number() OVER (PARTITION BY player_one, player_two ORDER BY tourney_date DESC, match_num DESC) = 1
"""


@query("d08_latest_sample_of_pair", "dual pairs", _D8)
def _(spark, folder):
    return views.latest_sample(dual(spark, folder), pairs(spark, folder))


@query("d08_latest_sample_by_name", "dual pairs", """
SELECT player_one, player_two, false AS swapped, match_id, match_num FROM pairs
JOIN dual ON lower(trim(player)) = lower(trim(player_one)) AND lower(trim(opponent)) = lower(trim(player_two))
QUALIFY row_number() OVER (PARTITION BY player_one, player_two ORDER BY tourney_date DESC, match_num DESC) = 1
""")
def _(spark, folder):
    asked = pairs(spark, folder).withColumn("player_one", F.upper("player_one"))
    found = views.latest_sample_by_name(dual(spark, folder), asked)
    return found.withColumn("player_one", F.initcap("player_one"))


@query("d08_latest_sample_known_in_reverse", "dual pairs", """
WITH won AS (SELECT lower(trim(player)) AS a, lower(trim(opponent)) AS b, match_id, match_num FROM dual WHERE label = 1
  QUALIFY row_number() OVER (PARTITION BY lower(trim(player)), lower(trim(opponent)) ORDER BY tourney_date DESC, match_num DESC) = 1)
SELECT player_one, player_two, d.match_num IS NULL AS swapped, coalesce(d.match_id, r.match_id) AS match_id, coalesce(d.match_num, r.match_num) AS match_num FROM pairs
LEFT JOIN won d ON d.a = lower(trim(player_one)) AND d.b = lower(trim(player_two)) LEFT JOIN won r ON r.a = lower(trim(player_two)) AND r.b = lower(trim(player_one))
WHERE d.match_num IS NOT NULL OR r.match_num IS NOT NULL
""")
def _(spark, folder):
    # samples stored from the winner's side only, so a pair may be known in reverse alone
    return views.latest_sample_by_name(dual(spark, folder).filter("label = 1"), pairs(spark, folder))


@query("d12_side_by_side", "shown pairs", """
WITH i AS (SELECT player, match_num, opponent, serve_pct, row_number() OVER (PARTITION BY player ORDER BY tourney_date, match_num) AS k FROM shown WHERE back <= 10),
a AS (SELECT player_one, player_two, k, opponent, serve_pct FROM pairs JOIN i ON player = player_one),
b AS (SELECT player_one, player_two, k, opponent, serve_pct FROM pairs JOIN i ON player = player_two)
SELECT coalesce(a.player_one, b.player_one) AS player_one, coalesce(a.player_two, b.player_two) AS player_two, CAST(coalesce(a.k, b.k) AS INTEGER) AS match_index,
  a.opponent AS one_opponent, round(a.serve_pct, 6) + 0.0 AS one_serve_pct, b.opponent AS two_opponent, round(b.serve_pct, 6) + 0.0 AS two_serve_pct
FROM a FULL JOIN b ON a.player_one = b.player_one AND a.player_two = b.player_two AND a.k = b.k
""")
def _(spark, folder):
    out = views.side_by_side(shown(spark, folder), pairs(spark, folder), ["opponent", "serve_pct"])
    return rounded(out, ["player_one", "player_two", "match_index", "one_opponent", "two_opponent"], ["one_serve_pct", "two_serve_pct"])


@query("c37_relative_probability", "shown pairs", """
WITH i AS (SELECT player, coalesce(nullif(serve_pct, 0), 0.5) / 2 + coalesce(nullif(return_pct, 0), 0.5) / 2 AS c, row_number() OVER (PARTITION BY player ORDER BY tourney_date, match_num) AS k FROM shown WHERE back <= 10)
SELECT player_one, player_two, CAST(a.k AS INTEGER) AS match_index, round(a.c / (a.c + b.c) * 100, 6) + 0.0 AS one_win_pct, round(100 - a.c / (a.c + b.c) * 100, 6) + 0.0 AS two_win_pct
FROM pairs JOIN i a ON a.player = player_one JOIN i b ON b.player = player_two AND a.k = b.k
""")
def _(spark, folder):
    rows = views.side_by_side(shown(spark, folder), pairs(spark, folder), ["serve_pct", "return_pct"])
    out = evaluate.relative_probability(rows)
    return rounded(out, ["player_one", "player_two", "match_index"], ["one_win_pct", "two_win_pct"])


@query("d03_feature_join", "rates", """
SELECT player, opponent, match_num, round(serve_pct, 6) + 0.0 AS serve_pct, CASE WHEN match_num % 3 = 0 THEN NULL ELSE round(return_pct, 6) + 0.0 END AS return_pct FROM rates
""")
def _(spark, folder):
    from courtlens.operators import joins
    df = player_table(spark, folder)
    left = df.select("player", "opponent", "match_id", "tourney_date", "match_num", r6(rates.serve_pct("player")).alias("serve_pct"))
    right = df.filter(F.col("match_num") % 3 != 0).select(
        "player", "opponent", "match_id", "tourney_date", "match_num", r6(rates.return_pct("opp")).alias("return_pct"))
    return joins.feature_join(left, right).select("player", "opponent", "match_num", "serve_pct", "return_pct")


@query("d04_deduplicated_join", "rates", """
SELECT a.player, a.opponent, a.match_num, round(first_value(serve_pct) OVER (PARTITION BY player, opponent, match_id, tourney_date ORDER BY match_num), 6) + 0.0 AS static_value FROM rates a
""")
def _(spark, folder):
    from courtlens.operators import joins
    df = player_table(spark, folder)
    keys = ["player", "opponent", "match_id", "tourney_date"]
    right = df.select(*keys, F.col("match_num").alias("_n"), r6(rates.serve_pct("player")).alias("static_value"))
    return joins.first_match_join(df.select(*keys, "match_num"), right, keys, [F.col("_n")], ["static_value"]).select(
        "player", "opponent", "match_num", "static_value")


# ---- tournaments -------------------------------------------------------------------------------

cte("scored", ("matches",), """
SELECT *, CASE WHEN winner_name < loser_name THEN raw_w ELSE 1.0 - raw_w END AS raw_one,
  least(winner_name, loser_name) AS player_one, greatest(winner_name, loser_name) AS player_two,
  CAST(winner_name < loser_name AS INTEGER) AS actual
FROM (SELECT *, CASE WHEN winner_rank IS NULL THEN 0.5 ELSE 1.0 / (1.0 + exp(-(loser_rank - winner_rank) / 50.0)) END AS raw_w FROM matches)
""")
cte("events_of", ("scored",), """
SELECT *, substr(CAST(tourney_date AS VARCHAR), 1, 4) || '-' || substr(CAST(tourney_date AS VARCHAR), 5, 2) AS year_month,
  CASE WHEN 1.0 - raw_one > raw_one THEN 0 ELSE 1 END AS guess
FROM (SELECT * REPLACE (CASE WHEN tourney_level IN ('B', '500') THEN 'A' ELSE tourney_level END AS tourney_level) FROM scored)
WHERE tourney_level <> 'D' AND tourney_name NOT LIKE '%United Cup%' AND tourney_name NOT LIKE '%Davis Cup%'
""")


def tournament_rows(spark, folder):
    from courtlens.queries.scoring import predictions
    return views.tournament_matches(predictions(spark, folder))


_E12 = """
SELECT tourney_name, year_month, arg_min(tourney_id, match_num) AS tournament_id, arg_min(tourney_level, match_num) AS tournament_level,
  coalesce(first(surface ORDER BY match_num), 'Hard') AS surface, min(tourney_date) AS start_date, max(tourney_date) AS end_date, count(*) AS matches,
  round(avg(CAST(guess = actual AS DOUBLE)), 6) + 0.0 AS accuracy FROM events_of GROUP BY 1, 2
"""


@query("e12_tournaments_e13_accuracy", "events_of", _E12)
def _(spark, folder):
    df = views.tournaments(tournament_rows(spark, folder))
    return rounded(df, [c for c in df.columns if c != "accuracy"], ["accuracy"])


@query("e14_round_rows", "events_of", """
SELECT tourney_name, year_month, round, CAST(list_position(['R128','R64','R32','R16','QF','SF','F'], round) - 1 AS INTEGER) AS round_no, match_num, player_one, player_two FROM events_of
WHERE round IN ('R128','R64','R32','R16','QF','SF','F')
""")
def _(spark, folder):
    return views.round_rows(tournament_rows(spark, folder)).select(
        "tourney_name", "year_month", "round", "round_no", "match_num", "player_one", "player_two")


@query("e14_round_sizes", "events_of", """
SELECT tourney_name, year_month, CAST(list_position(['R128','R64','R32','R16','QF','SF','F'], round) - 1 AS INTEGER) AS round_no, round, count(*) AS matches FROM events_of GROUP BY ALL
""")
def _(spark, folder):
    return views.round_sizes(tournament_rows(spark, folder))


@query("e25_tournament_list", "events_of", f"""
SELECT tourney_name, start_date, tournament_id, tournament_level, matches, CASE tournament_level WHEN 'G' THEN 'Grand Slam' WHEN 'M' THEN 'ATP 1000' ELSE 'ATP 500/250' END AS tier FROM ({_E12})
WHERE tournament_level IN ('G','M','500','250','A') QUALIFY row_number() OVER (PARTITION BY tourney_name, start_date ORDER BY tournament_id, year_month) = 1
""")
def _(spark, folder):
    listed = views.tournament_list(views.tournaments(tournament_rows(spark, folder)))
    return listed.orderBy("tier", F.col("start_date").desc(), "tourney_name").select(
        "tourney_name", "start_date", "tournament_id", "tournament_level", "matches", "tier")


@query("g05_newest_tournaments_per_tier", "events_of", f"""
SELECT tier, tourney_name, start_date FROM (SELECT tourney_name, start_date, CASE tournament_level WHEN 'G' THEN 'Grand Slam' WHEN 'M' THEN 'ATP 1000' ELSE 'ATP 500/250' END AS tier FROM ({_E12}))
QUALIFY row_number() OVER (PARTITION BY tier ORDER BY start_date DESC, tourney_name) <= 3
""")
def _(spark, folder):
    listed = views.tournament_list(views.tournaments(tournament_rows(spark, folder)))
    from pyspark.sql import Window
    w = Window.partitionBy("tier").orderBy(F.col("start_date").desc(), "tourney_name")
    return listed.withColumn("no", F.row_number().over(w)).filter("no <= 3").select("tier", "tourney_name", "start_date")
