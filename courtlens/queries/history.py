"""Rates, windows, as-of lookups and sequences (families C, D1, F, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.functions import categories, decay, rates, ranks
from courtlens.operators import sequences, windows
from courtlens.operators.timeline import newest
from courtlens.plans import features, legacy
from courtlens.queries.base import cte, dual, match_table, player_table, query, r6, rounded, sql_r6
from courtlens.session import cut_lineage

_ID = ["player", "opponent", "match_num"]
_ID_SQL = "player, opponent, match_num"


def rated(spark, folder, *carry):
    return features.with_rates(player_table(spark, folder, *carry))


def served(spark, folder, *carry):
    """Player table with serve and return shares."""
    return player_table(spark, folder, *carry).withColumns({
        "serve_pct": rates.serve_pct("player"), "return_pct": rates.return_pct("opp")})


# ---- C1-C5 ---------------------------------------------------------------------------------

_SERVE = ["player_1st_in_pct", "player_1st_win_pct", "player_2nd_win_pct", "player_ace_rate",
          "player_df_rate", "player_bp_save_pct"]
_RETURN = ["player_1st_return_win_pct", "player_2nd_return_win_pct", "player_bp_convert_pct"]


@query("c01_safe_ratio", "dual", f"SELECT {_ID_SQL}, round(coalesce(CAST(player_ace AS DOUBLE)/nullif(CAST(player_svpt AS DOUBLE),0),0.0),6)+0.0 AS ratio FROM dual")
def _(spark, folder):
    df = player_table(spark, folder)
    return df.select(*_ID, r6(rates.safe_ratio(F.col("player_ace"), F.col("player_svpt"))).alias("ratio"))


@query("c02_serve_rates", "rates", f"SELECT {_ID_SQL}, {sql_r6(*_SERVE)} FROM rates")
def _(spark, folder):
    return rounded(rated(spark, folder), _ID, _SERVE)


@query("c03_return_rates", "rates", f"SELECT {_ID_SQL}, {sql_r6(*_RETURN)} FROM rates")
def _(spark, folder):
    return rounded(rated(spark, folder), _ID, _RETURN)


@query("c04_serve_return_pct", "rates", f"SELECT {_ID_SQL}, {sql_r6('serve_pct', 'return_pct')} FROM rates")
def _(spark, folder):
    return rounded(served(spark, folder), _ID, ["serve_pct", "return_pct"])


# ---- C6-C9, C13, C17, C18 -------------------------------------------------------------------

def _strength(rank: str) -> str:
    return (f"CASE WHEN {rank} > 0 THEN greatest(0.0, least(1.0, 1.0 - ln(greatest({rank}, 1.0)) / ln(2000.0))) "
            "ELSE 0.0 END")


def _code(value: str, order) -> str:
    listed = "[" + ", ".join(f"'{o}'" for o in order) + "]"
    return (f"CAST(CASE WHEN coalesce(list_position({listed}, coalesce({value}, '{order[-1]}')), 0) > 0 "
            f"THEN list_position({listed}, coalesce({value}, '{order[-1]}')) - 1 ELSE {len(order) - 1} END AS INTEGER)")


cte("steps_in", ("rates",), f"""
SELECT *, serve_pct - (0.65 - 0.10 * opp_rank_norm) AS adj_serve FROM (
  SELECT *, {_strength('opponent_rank')} AS opp_rank_norm, {_strength('player_rank')} AS player_rank_norm,
    {_code('surface', categories.SURFACES)} AS surface_idx, {_code('tourney_level', categories.LEVELS)} AS tourney_level_idx,
    {_code('round', categories.ROUNDS)} AS round_idx,
    CAST(greatest(least(coalesce(day - lag(day) OVER (PARTITION BY player ORDER BY tourney_date, match_num), 0), 365), 0) AS DOUBLE) AS days_since_prev
  FROM rates)
""")


@query("c06_rank_strength", "steps_in", f"SELECT {_ID_SQL}, {sql_r6('player_rank_norm')} FROM steps_in")
def _(spark, folder):
    df = dual(spark, folder)
    return df.select(*_ID, r6(ranks.rank_strength(F.col("player_rank"))).alias("player_rank_norm"))


@query("c07_rank_difference", "steps_in", f"SELECT {_ID_SQL}, round(player_rank_norm - opp_rank_norm, 6) + 0.0 AS rank_diff FROM steps_in")
def _(spark, folder):
    gap = ranks.rank_strength(F.col("player_rank")) - ranks.rank_strength(F.col("opponent_rank"))
    return dual(spark, folder).select(*_ID, r6(gap).alias("rank_diff"))


@query("c08_category_codes", "steps_in", f"SELECT {_ID_SQL}, surface_idx, tourney_level_idx, round_idx FROM steps_in")
def _(spark, folder):
    df = dual(spark, folder, "surface", "tourney_level", "round")
    return df.select(
        *_ID, categories.code_of(F.col("surface"), categories.SURFACES).alias("surface_idx"),
        categories.code_of(F.col("tourney_level"), categories.LEVELS).alias("tourney_level_idx"),
        categories.code_of(F.col("round"), categories.ROUNDS).alias("round_idx"))


def step_inputs(spark, folder):
    return legacy.with_step_inputs(player_table(spark, folder, "tourney_level", "round"))


@query("c09_adjusted_serve", "steps_in", f"SELECT {_ID_SQL}, {sql_r6('adj_serve')} FROM steps_in")
def _(spark, folder):
    df = served(spark, folder)
    value = rates.opponent_adjusted_serve(F.col("serve_pct"), ranks.rank_strength(F.col("opponent_rank")))
    return df.select(*_ID, r6(value).alias("adj_serve"))


@query("c13_surface_one_hot", "dual", f"""
SELECT {_ID_SQL}, {", ".join(f"CAST(coalesce(trim(surface),'') = '{s}' AS DOUBLE) AS \"surface_{s}\"" for s in categories.ONE_HOT_SURFACES)} FROM dual
""")
def _(spark, folder):
    df = features.with_surface(dual(spark, folder, "surface"))
    return df.select(*_ID, *[f"surface_{s}" for s in categories.ONE_HOT_SURFACES])


@query("c17_finite_or_zero", "", """
SELECT event_id, CASE WHEN user_id % 4 <> 3 THEN 0.0 ELSE round(value, 6) + 0.0 END AS value FROM events
""")
def _(spark, folder):
    df = spark.read.parquet(f"{folder}/events.parquet")
    odd = (F.when(F.col("user_id") % 4 == 0, F.lit(float("nan"))).when(F.col("user_id") % 4 == 1, F.lit(float("inf")))
           .when(F.col("user_id") % 4 == 2, F.lit(float("-inf"))).otherwise(F.col("value")))
    return df.select("event_id", r6(rates.finite_or_zero(odd)).alias("value"))


@query("c18_decay_weights", "", """
SELECT CAST(p_size AS INTEGER) AS length, CAST(pos AS INTEGER) AS step, n,
  round(exp(-(p_size - pos) * ln(2.0) / 3.0) / sum(exp(-(p_size - pos) * ln(2.0) / 3.0)) OVER (PARTITION BY p_size), 6) + 0.0 AS weight
FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1), LATERAL (SELECT unnest(range(1, p_size + 1)) AS pos)
""")
def _(spark, folder):
    sizes = spark.read.parquet(f"{folder}/part.parquet").groupBy(F.col("p_size").cast("int").alias("length")).agg(
        F.count(F.lit(1)).alias("n"))
    weights = decay.half_life_weights(F.col("length"), F.lit(decay.HALF_LIFE))
    return sizes.select("length", "n", F.posexplode(weights).alias("i", "w")).select(
        "length", (F.col("i") + 1).alias("step"), "n", r6("w").alias("weight"))


# ---- F1-F3, C10-C12, C14, D1 ----------------------------------------------------------------

_ROLL = [f"{r}_roll{w}" for w in features.WINDOWS for r in features.ROLLED]


def _roll_sql() -> str:
    parts = []
    for w in features.WINDOWS:
        for r in features.ROLLED:
            parts.append(f"avg({r}) OVER (PARTITION BY player ORDER BY tourney_date, match_num "
                         f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {r}_roll{w}")
    return ",\n ".join(parts)


def _skill_sql(w: int) -> tuple[str, str]:
    def c(n):
        return f"coalesce({n}_roll{w}, 0.0)"
    serve = (f"(0.4*{c('player_1st_win_pct')} + 0.4*{c('player_2nd_win_pct')} + 0.1*{c('player_ace_rate')} "
             f"- 0.1*{c('player_df_rate')})")
    return serve, f"(0.5*{c('player_1st_return_win_pct')} + 0.5*{c('player_2nd_return_win_pct')})"


cte("rolled", ("rates",), f"""
SELECT *, {_roll_sql()},
 CAST(greatest(least(coalesce(day - lag(day) OVER (PARTITION BY player ORDER BY tourney_date, match_num), 0), 365), 0) AS DOUBLE) AS days_since_last_match
FROM rates
""")
cte("skilled", ("rolled",), f"""
SELECT *, {_skill_sql(10)[0]}::DOUBLE AS serve_skill, {_skill_sql(10)[1]}::DOUBLE AS return_skill,
  ({_skill_sql(5)[0]} - {_skill_sql(30)[0]})::DOUBLE AS serve_form_delta, ({_skill_sql(5)[1]} - {_skill_sql(30)[1]})::DOUBLE AS return_form_delta
FROM rolled
""")
cte("faced", ("skilled",), """
SELECT a.*, coalesce(b.serve_skill, 0.0) AS opp_serve_skill, coalesce(b.return_skill, 0.0) AS opp_return_skill
FROM skilled a ASOF LEFT JOIN (SELECT player AS who, tourney_date * 10000000000 + match_num AS at, serve_skill, return_skill FROM skilled) b
ON a.opponent = b.who AND a.tourney_date * 10000000000 + a.match_num >= b.at
""")
cte("edged", ("faced",), f"""
SELECT *, serve_vs_return_edge + return_vs_serve_edge AS net_edge, actual_spw - expected_spw AS spw_diff, actual_rpw - expected_rpw AS rpw_diff
FROM (SELECT *, serve_skill - opp_return_skill AS serve_vs_return_edge, return_skill - opp_serve_skill AS return_vs_serve_edge,
  serve_skill - opp_return_skill AS expected_spw, serve_pct AS actual_spw, return_skill - opp_serve_skill AS expected_rpw,
  1.0 - coalesce(CAST(opp_1stWon + opp_2ndWon AS DOUBLE)/nullif(CAST(opp_svpt AS DOUBLE),0), 0.0) AS actual_rpw,
  CAST(coalesce(trim(surface),'') = 'Hard' AS DOUBLE) AS "surface_Hard", CAST(coalesce(trim(surface),'') = 'Clay' AS DOUBLE) AS "surface_Clay",
  CAST(coalesce(trim(surface),'') = 'Grass' AS DOUBLE) AS "surface_Grass" FROM faced)
""")


@query("f01_rolling_rates", "rolled", f"SELECT {_ID_SQL}, {sql_r6(*_ROLL)} FROM rolled")
def _(spark, folder):
    return rounded(features.with_rolling(rated(spark, folder)), _ID, _ROLL)


@query("c10_skills", "skilled", f"SELECT {_ID_SQL}, {sql_r6('serve_skill', 'return_skill')} FROM skilled")
def _(spark, folder):
    df = features.with_skills(features.with_rolling(rated(spark, folder), windows=(10,)))
    return rounded(df, _ID, ["serve_skill", "return_skill"])


@query("c12_form_deltas", "skilled", f"SELECT {_ID_SQL}, {sql_r6('serve_form_delta', 'return_form_delta')} FROM skilled")
def _(spark, folder):
    df = features.with_form(features.with_rolling(rated(spark, folder), windows=(5, 30)))
    return rounded(df, _ID, ["serve_form_delta", "return_form_delta"])


@query("flagship_latest_skills", "skilled", """
SELECT player, match_num, tourney_date, round(serve_skill, 6) + 0.0 AS serve_skill, round(return_skill, 6) + 0.0 AS return_skill
FROM skilled QUALIFY row_number() OVER (PARTITION BY player ORDER BY tourney_date DESC, match_num DESC) = 1
""")
def _(spark, folder):
    # the newest row of a player needs no more than the ten before it
    recent = newest(rated(spark, folder), features.KEY, features.ORDER, 11).drop("recent_no")
    df = features.with_skills(features.with_rolling(recent, windows=(10,)))
    latest = df.groupBy("player").agg(F.max_by(
        F.struct("match_num", "tourney_date", "serve_skill", "return_skill"), F.struct("tourney_date", "match_num")).alias("r"))
    return rounded(latest.select("player", "r.*"), ["player", "match_num", "tourney_date"], ["serve_skill", "return_skill"])


def skilled(spark, folder, *carry):
    slim = rated(spark, folder, *carry)
    return features.with_skills(features.with_rolling(slim, windows=(10,)))


def staged_skills(spark, folder):
    """Skills stored once: as-of joins read them from both sides."""
    return cut_lineage(skilled(spark, folder).select(
        *_ID, "tourney_date", "serve_skill", "return_skill", "player_1stWon", "player_2ndWon", "player_svpt",
        "opp_1stWon", "opp_2ndWon", "opp_svpt"))


_OPP = ["opp_serve_skill", "opp_return_skill"]


@query("d01_opponent_skills_asof", "faced", f"SELECT {_ID_SQL}, {sql_r6(*_OPP)} FROM faced")
def _(spark, folder):
    return rounded(features.with_opponent_skills(staged_skills(spark, folder)), _ID, _OPP)


@query("d01_opponent_skills_before_date", "skilled", f"""
SELECT {_ID_SQL}, round(coalesce(b.serve_skill, 0.0),6)+0.0 AS opp_serve_skill, round(coalesce(b.return_skill,0.0),6)+0.0 AS opp_return_skill
FROM (SELECT {_ID_SQL}, tourney_date FROM skilled) a ASOF LEFT JOIN (
  SELECT player AS who, tourney_date AS at, serve_skill, return_skill FROM skilled
  QUALIFY row_number() OVER (PARTITION BY player, tourney_date ORDER BY match_num DESC) = 1) b
ON a.opponent = b.who AND a.tourney_date > b.at
""")
def _(spark, folder):
    return rounded(features.with_opponent_skills(staged_skills(spark, folder), "before"), _ID, _OPP)


@query("d01_opponent_skills_last_on_date", "skilled", f"""
SELECT {_ID_SQL}, round(coalesce(b.serve_skill, 0.0),6)+0.0 AS opp_serve_skill, round(coalesce(b.return_skill,0.0),6)+0.0 AS opp_return_skill
FROM (SELECT {_ID_SQL}, tourney_date FROM skilled) a ASOF LEFT JOIN (
  SELECT player AS who, tourney_date AS at, serve_skill, return_skill FROM skilled
  QUALIFY row_number() OVER (PARTITION BY player, tourney_date ORDER BY match_num DESC) = 1) b
ON a.opponent = b.who AND a.tourney_date >= b.at
""")
def _(spark, folder):
    return rounded(features.with_opponent_skills(staged_skills(spark, folder), "day"), _ID, _OPP)


_C11 = ["expected_spw", "actual_spw", "spw_diff", "expected_rpw", "actual_rpw", "rpw_diff"]


@query("c11_expected_and_actual_points", "edged", f"SELECT {_ID_SQL}, {sql_r6(*_C11)} FROM edged")
def _(spark, folder):
    df = features.with_expectation(features.with_opponent_skills(staged_skills(spark, folder)))
    return rounded(df, _ID, _C11)


_C14 = ["serve_vs_return_edge", "return_vs_serve_edge", "net_edge"]


@query("c14_matchup_edges", "edged", f"SELECT {_ID_SQL}, {sql_r6(*_C14)} FROM edged")
def _(spark, folder):
    return rounded(features.with_edges(features.with_opponent_skills(staged_skills(spark, folder))), _ID, _C14)


_F2 = ["surface_serve_skill", "surface_return_skill"]


@query("f02_surface_skills", "skilled", f"""
SELECT {_ID_SQL}, {", ".join(f"round(CASE WHEN s IN ('Hard','Clay','Grass') THEN coalesce(avg({c}) OVER (PARTITION BY player, s ORDER BY tourney_date, match_num ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0.0) ELSE 0.0 END, 6) + 0.0 AS surface_{c}" for c in ('serve_skill', 'return_skill'))}
FROM (SELECT *, coalesce(trim(surface), '') AS s FROM skilled)
""")
def _(spark, folder):
    return rounded(features.with_surface_skills(skilled(spark, folder)), _ID, _F2)


@query("f03_days_since_previous", "steps_in", f"SELECT {_ID_SQL}, days_since_prev FROM steps_in")
def _(spark, folder):
    return windows.days_since_previous(dual(spark, folder)).select(*_ID, "days_since_prev")


@query("c16_log_days", "steps_in", f"SELECT {_ID_SQL}, round(ln(1 + days_since_prev), 6) + 0.0 AS days_since_prev_log FROM steps_in")
def _(spark, folder):
    df = windows.days_since_previous(dual(spark, folder))
    return df.select(*_ID, r6(F.log1p("days_since_prev")).alias("days_since_prev_log"))


# ---- F4-F9, J11 ------------------------------------------------------------------------------

_STEP_LIST = "{" + ", ".join(f"'{f}': \"{f}\"" for f in features.SEQUENCE_FEATURES) + "}"


@query("f04_row_sequences", "edged", f"""
SELECT player, match_num, CAST(i AS INTEGER) AS step, {", ".join(f'round(x."{f}", 6) + 0.0 AS "{f}"' for f in features.SEQUENCE_FEATURES)}
FROM (SELECT player, match_num, list({_STEP_LIST}) OVER (PARTITION BY player ORDER BY tourney_date, match_num ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seq FROM edged),
  LATERAL (SELECT unnest(range(1, 11)) AS i), LATERAL (SELECT seq[i] AS x)
WHERE len(seq) = 10
""")
def _(spark, folder):
    def shown(df):  # a value is rounded once, not in each of the ten sequences it is a step of
        return features.faced_features(df).withColumns({f: r6(rates.finite_or_zero(F.col(f))) for f in features.SEQUENCE_FEATURES})

    own = cut_lineage(features.own_features(rated(spark, folder)))
    df = sequences.row_sequences(features.with_opponent_skills(own), features.SEQUENCE_FEATURES, derive=shown)
    return df.select("player", "match_num", F.posexplode("sequence").alias("i", "x")).select(
        "player", "match_num", (F.col("i") + 1).alias("step"), "x.*")


cte("strict", ("steps_in",), """
SELECT a.*, coalesce(h.hist, []) AS hist FROM steps_in a LEFT JOIN (
  SELECT player, tourney_date, hist[greatest(len(hist) - 9, 1):] AS hist FROM (
    SELECT player, tourney_date, list({'d': tourney_date, 'adj_serve': adj_serve, 'opp_rank_norm': opp_rank_norm, 'surface_idx': CAST(surface_idx AS DOUBLE), 'days': days_since_prev})
      OVER (PARTITION BY player ORDER BY tourney_date, match_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist
    FROM steps_in QUALIFY row_number() OVER (PARTITION BY player, tourney_date ORDER BY match_num) = 1)
) h USING (player, tourney_date)
""")


@query("f05_strict_history", "strict", f"""
SELECT player, match_num, CAST(i AS INTEGER) AS step, CAST(i > 10 - len(hist) AS DOUBLE) AS mask,
  CASE WHEN i > 10 - len(hist) THEN hist[i - 10 + len(hist)].d ELSE 0 END AS step_date,
  CASE WHEN i > 10 - len(hist) THEN round(hist[i - 10 + len(hist)].adj_serve, 6) + 0.0 ELSE 0.0 END AS adj_serve
FROM strict, LATERAL (SELECT unnest(range(1, 11)) AS i)
""")
def _(spark, folder):
    hist = sequences.strict_history(step_inputs(spark, folder), ["adj_serve"])
    plain = F.transform("history", lambda x: F.struct(x["_day"].alias("step_date"), x.adj_serve.alias("adj_serve")))
    blank = F.array_repeat(F.struct(F.lit(0).alias("step_date"), F.lit(0.0).alias("adj_serve")), F.lit(10) - F.size("history"))
    out = hist.select("player", "match_num", F.posexplode(F.arrays_zip(
        F.concat(blank, plain).alias("s"), sequences.mask_of(F.size("history")).alias("m"))).alias("i", "x"))
    return out.select("player", "match_num", (F.col("i") + 1).alias("step"), F.col("x.m").alias("mask"),
                      F.col("x.s.step_date").alias("step_date"), r6("x.s.adj_serve").alias("adj_serve"))


def _weighted(prior: str, speed: float) -> str:
    n = f"len({prior})"
    w = f"list_transform(range(0, {n}), lambda q: exp(-{speed} * ({n} - 1 - q)))"
    return f"(list_dot_product(CAST({prior} AS DOUBLE[]), {w}) / list_sum({w}))"


cte("stepped", ("strict",), f"""
SELECT player, match_num, tourney_date, k, len(hist) AS m, x.opp_rank_norm AS opponent_rank_norm, x.surface_idx AS surface_idx, x.days AS days_since_prev,
  CASE WHEN k = 1 THEN x.adj_serve WHEN k = 2 THEN v[1] WHEN k = 3 THEN (0.10*v[1] + 0.25*v[2]) / 0.35
    ELSE 0.10*v[k-3] + 0.25*v[k-2] + 0.65*v[k-1] END AS short,
  CASE WHEN k = 1 THEN x.adj_serve ELSE {_weighted('v[1:k-1]', 0.15)} END AS medium,
  CASE WHEN k = 1 THEN x.adj_serve ELSE {_weighted('v[1:k-1]', 0.4)} END AS ewm10,
  CASE WHEN k = 1 THEN x.adj_serve ELSE {_weighted('v[greatest(k-3,1):k-1]', 0.4)} END AS ewm3
FROM (SELECT *, list_transform(hist, lambda h: h.adj_serve) AS v FROM strict WHERE len(hist) > 0),
  LATERAL (SELECT unnest(range(1, len(hist) + 1)) AS k), LATERAL (SELECT hist[k] AS x)
""")


@query("f06_short_and_medium_decay", "stepped", """
SELECT player, match_num, CAST(10 - m + k AS INTEGER) AS step, round(short, 6) + 0.0 AS adj_serve_short_decay,
  round(medium, 6) + 0.0 AS adj_serve_medium_decay, round(short - medium, 6) + 0.0 AS form_delta_serve,
  round(opponent_rank_norm, 6) + 0.0 AS opponent_rank_norm, surface_idx, days_since_prev FROM stepped
""")
def _(spark, folder):
    df = legacy.with_sequences(step_inputs(spark, folder))
    steps = df.select("player", "match_num", F.posexplode(F.arrays_zip(F.col("sequence").alias("s"), F.col("mask").alias("m"))).alias("i", "x"))
    return rounded(
        steps.filter("x.m > 0").select("player", "match_num", (F.col("i") + 1).alias("step"), "x.s.*"),
        ["player", "match_num", "step", "surface_idx", "days_since_prev"],
        ["adj_serve_short_decay", "adj_serve_medium_decay", "form_delta_serve", "opponent_rank_norm"])


@query("f08_recency_means_without_rank", "stepped", """
SELECT player, match_num, CAST(k AS INTEGER) AS step, round(ewm10, 6) + 0.0 AS rpw_adj_last10,
  round(ewm3, 6) + 0.0 AS rpw_adj_last3, round(ewm10, 6) + 0.0 AS net_skill_last10 FROM stepped
""")
def _(spark, folder):
    # the recency means are fed with the adjusted serve so that plain SQL can check them
    df = step_inputs(spark, folder).withColumns({"adj_rpw": F.col("adj_serve"), "net_skill": F.col("adj_serve")})
    hist = sequences.strict_history(df, [*legacy.STEP_INPUT, "adj_rpw", "net_skill"])
    steps = hist.select("player", "match_num", F.posexplode(sequences.decayed_steps(F.col("history"), use_rank=False)).alias("i", "x"))
    return rounded(steps.select("player", "match_num", (F.col("i") + 1).alias("step"), "x.*"),
                   ["player", "match_num", "step"], ["rpw_adj_last10", "rpw_adj_last3", "net_skill_last10"])


@query("f09_last_valid_step", "dual stepped", """
SELECT a.player, a.match_num, round(coalesce(medium, 0.0), 6) + 0.0 AS recent_weighted_serve,
  round(coalesce(short - medium, 0.0), 6) + 0.0 AS form_delta_serve
FROM dual a LEFT JOIN (SELECT * FROM stepped WHERE k = m) s ON a.player = s.player AND a.match_num = s.match_num
""")
def _(spark, folder):
    df = legacy.with_sequences(step_inputs(spark, folder))
    return df.select(
        "player", "match_num",
        r6(sequences.last_valid(F.col("sequence"), F.col("mask"), "adj_serve_medium_decay")).alias("recent_weighted_serve"),
        r6(sequences.last_valid(F.col("sequence"), F.col("mask"), "form_delta_serve")).alias("form_delta_serve"))


@query("j11_past_only_violations", "strict", """
SELECT count(*) AS rows_checked, count(*) FILTER (WHERE len(hist) > 10 OR len(list_filter(hist, lambda h: h.d >= tourney_date)) > 0) AS violations FROM strict
""")
def _(spark, folder):
    df = legacy.with_sequences(step_inputs(spark, folder))
    bad = sequences.breaks_invariant("history", "sequence", "mask")
    return df.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(bad).alias("violations"))


# ---- F10-F13 ----------------------------------------------------------------------------------

@query("f10_career_before", "dual", f"""
SELECT {_ID_SQL}, n AS career_matches_prior, CAST(w AS BIGINT) AS career_wins_prior, round(CAST(w AS DOUBLE) / greatest(n, 1), 6) + 0.0 AS career_win_pct
FROM (SELECT *, count(*) OVER p AS n, coalesce(sum(label) OVER p, 0) AS w FROM dual
  WINDOW p AS (PARTITION BY player ORDER BY tourney_date RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""")
def _(spark, folder):
    return windows.career_before(dual(spark, folder)).select(
        *_ID, "career_matches_prior", "career_wins_prior", r6("career_win_pct").alias("career_win_pct"))


@query("f11_pair_before", "dual", f"""
SELECT {_ID_SQL}, CAST(len(l) AS BIGINT) AS h2h_total_matches, CAST(coalesce(list_sum(l), 0) AS BIGINT) AS h2h_total_wins,
  CAST(coalesce(list_sum(l[greatest(len(l)-4, 1):]), 0) AS INTEGER) AS h2h_recent_wins, CAST(coalesce(l[-1], 0) AS INTEGER) AS h2h_last_result
FROM (SELECT a.player, a.opponent, a.match_num, coalesce(list(b.label ORDER BY b.tourney_date, b.match_num) FILTER (WHERE b.label IS NOT NULL), []) AS l
  FROM dual a LEFT JOIN dual b ON a.player = b.player AND a.opponent = b.opponent AND b.tourney_date < a.tourney_date GROUP BY ALL)
""")
def _(spark, folder):
    return windows.pair_before(dual(spark, folder)).select(
        *_ID, "h2h_total_matches", "h2h_total_wins", "h2h_recent_wins", "h2h_last_result")


cte("runs", ("dual",), """
SELECT *, row_number() OVER (PARTITION BY player, label, isl ORDER BY tourney_date, match_num) * CASE WHEN label = 1 THEN 1 ELSE -1 END AS after_run
FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY tourney_date, match_num) - row_number() OVER (PARTITION BY player, label ORDER BY tourney_date, match_num) AS isl FROM dual)
""")


@query("f12_streaks", "runs", f"""
SELECT {_ID_SQL}, CAST(coalesce(lag(after_run) OVER (PARTITION BY player ORDER BY tourney_date, match_num), 0) AS BIGINT) AS prior_streak,
  CAST(after_run AS BIGINT) AS streak_after FROM runs
""")
def _(spark, folder):
    return windows.streaks(dual(spark, folder)).select(*_ID, "prior_streak", "streak_after")


@query("f13_stored_streak", "runs", f"""
SELECT {_ID_SQL}, CAST(coalesce(sum(CASE WHEN isl = first_isl AND label = first_label THEN CASE WHEN label = 1 THEN 1 ELSE -1 END ELSE 0 END)
  OVER (PARTITION BY player ORDER BY tourney_date RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stored_streak
FROM (SELECT *, first_value(isl) OVER p AS first_isl, first_value(label) OVER p AS first_label FROM runs WINDOW p AS (PARTITION BY player ORDER BY tourney_date, match_num))
""")
def _(spark, folder):
    return windows.first_run_streak(dual(spark, folder)).select(*_ID, "stored_streak")


# ---- F14-F27: report curves ------------------------------------------------------------------

cte("recent", ("rates",), """
SELECT *, row_number() OVER (PARTITION BY player ORDER BY tourney_date DESC, match_num DESC) AS back FROM rates
""")
_W = "PARTITION BY player ORDER BY tourney_date, match_num"
_F14 = [f"{s}_avg{n}" for s in ("serve_pct", "return_pct") for n in (3, 10, 25)]


@query("f14_rolling_serve_return", "rates", f"""
SELECT {_ID_SQL}, {", ".join(f"round(avg({s}) OVER ({_W} ROWS BETWEEN {n-1} PRECEDING AND CURRENT ROW) * 100, 6) + 0.0 AS {s}_avg{n}" for s in ("serve_pct", "return_pct") for n in (3, 10, 25))} FROM rates
""")
def _(spark, folder):
    return rounded(windows.rolling_including_current(served(spark, folder), ["serve_pct", "return_pct"]), _ID, _F14)


@query("f15_surface_form", "recent", f"""
SELECT player, match_num, {", ".join(f"round(avg(CAST(label AS DOUBLE)) OVER ({_W} ROWS BETWEEN {k-1} PRECEDING AND CURRENT ROW) * 100, 6) + 0.0 AS win_pct{k}" for k in (3, 10))}
FROM (SELECT * FROM rates WHERE surface = 'Clay' QUALIFY row_number() OVER (PARTITION BY player ORDER BY tourney_date DESC, match_num DESC) <= 15)
""")
def _(spark, folder):
    return rounded(windows.surface_form(dual(spark, folder, "surface"), "Clay"), ["player", "match_num"], ["win_pct3", "win_pct10"])


@query("f16_expanding_win_rate", "recent", f"""
SELECT player, match_num, CAST(row_number() OVER ({_W}) AS INTEGER) AS match_index, round(avg(CAST(label AS DOUBLE)) OVER ({_W} ROWS UNBOUNDED PRECEDING) * 100, 6) + 0.0 AS win_rate
FROM recent WHERE back <= 10
""")
def _(spark, folder):
    return rounded(windows.expanding_win_rate(dual(spark, folder)), ["player", "match_num", "match_index"], ["win_rate"])


@query("f17_volatility_f18_form_rating", "rates", f"""
SELECT player, match_num, round(CASE WHEN count(*) OVER t >= 10 THEN least(100.0, stddev_pop(serve_pct + return_pct) OVER t * 200) END, 6) + 0.0 AS volatility,
  round(least(100.0, avg(CAST(label AS DOUBLE)) OVER t * 100 * 0.4 + greatest(0.0, (1000 - avg(coalesce(nullif(opponent_rank, 0), 1000.0)) OVER t) / 10) * 0.3
  + (coalesce(avg(CASE WHEN serve_pct > 0 THEN serve_pct END) OVER t, 0.0) + coalesce(avg(CASE WHEN return_pct > 0 THEN return_pct END) OVER t, 0.0)) / 2 * 100 * 0.3), 6) + 0.0 AS form_rating
FROM rates WINDOW t AS ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
""")
def _(spark, folder):
    return rounded(windows.volatility_and_form(served(spark, folder)), ["player", "match_num"], ["volatility", "form_rating"])


@query("f19_momentum", "rates", f"""
SELECT player, match_num, round(avg(CAST(label AS DOUBLE)) OVER t * 50 + (avg(serve_pct) OVER t + avg(return_pct) OVER t) / 2 * 50, 6) + 0.0 AS momentum
FROM rates WINDOW t AS ({_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def _(spark, folder):
    return rounded(windows.momentum(served(spark, folder)), ["player", "match_num"], ["momentum"])


@query("f20_expected_and_actual_play", "recent", f"""
SELECT player, match_num, round(e, 6) + 0.0 AS expected, round(a, 6) + 0.0 AS actual, round(a - e, 6) + 0.0 AS difference FROM (
  SELECT player, match_num, (avg(serve_pct) OVER t + avg(return_pct) OVER t) / 2 * 100 AS e,
    CASE WHEN serve_pct <> 0 AND return_pct <> 0 THEN (serve_pct + return_pct) / 2 * 100 END AS a
  FROM recent WHERE back <= 25 WINDOW t AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE e IS NOT NULL AND a IS NOT NULL
""")
def _(spark, folder):
    return rounded(windows.expected_and_actual(served(spark, folder)), ["player", "match_num"], ["expected", "actual", "difference"])


@query("f21_slopes", "recent", f"""
SELECT player, match_num, CAST(i AS INTEGER) AS match_index, {", ".join(f"round(CASE WHEN count(*) OVER t >= 2 THEN regr_slope({s}_pct * 100, i) OVER t END, 6) + 0.0 AS {s}_slope" for s in ("serve", "return"))}
FROM (SELECT *, row_number() OVER ({_W}) AS i FROM recent WHERE back <= 10) WINDOW t AS (PARTITION BY player ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def _(spark, folder):
    return rounded(windows.slopes(served(spark, folder)), ["player", "match_num", "match_index"], ["serve_slope", "return_slope"])


def _wm(c: str) -> str:
    # weights grow by 2^(1/3) per match, which is the same as halving every three matches back
    return (f"round(sum({c} * 100 * pow(2.0, i / 3.0)) OVER t / sum(pow(2.0, i / 3.0)) OVER t, 6) + 0.0")


@query("f22_weighted_and_plain", "recent", f"""
SELECT player, match_num, {_wm('serve_pct')} AS serve_weighted, {_wm('return_pct')} AS return_weighted,
  round(avg(serve_pct * 100) OVER t, 6) + 0.0 AS serve_raw, round(avg(return_pct * 100) OVER t, 6) + 0.0 AS return_raw
FROM (SELECT *, row_number() OVER ({_W}) AS i FROM recent WHERE back <= 10) WINDOW t AS (PARTITION BY player ORDER BY i ROWS UNBOUNDED PRECEDING)
""")
def _(spark, folder):
    return rounded(windows.weighted_and_plain(served(spark, folder)), ["player", "match_num"],
                   ["serve_weighted", "return_weighted", "serve_raw", "return_raw"])


@query("f23_rest_days", "recent", f"""
SELECT player, match_num, CAST(i AS INTEGER) AS match_index, CAST(coalesce(day - lag(day) OVER (PARTITION BY player ORDER BY i), 0) AS INTEGER) AS days_rest,
  {", ".join(f"round(CASE WHEN i >= 3 THEN avg({s}_pct) OVER t END, 6) + 0.0 AS rolling_{s}" for s in ("serve", "return"))}
FROM (SELECT *, row_number() OVER ({_W}) AS i FROM recent WHERE back <= 10) WINDOW t AS (PARTITION BY player ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def _(spark, folder):
    return rounded(windows.rest_days(served(spark, folder)), ["player", "match_num", "match_index", "days_rest"],
                   ["rolling_serve", "rolling_return"])


@query("f24_days_until_as_of", "recent", """
SELECT player, match_num, CAST(greatest(DATE '2001-08-06' - day, 0) AS INTEGER) AS days FROM recent WHERE back <= 6
""")
def _(spark, folder):
    return windows.days_until(dual(spark, folder), "2001-08-06").select("player", "match_num", "days")


@query("b25_last_year_rows", "dual", "SELECT player, match_num FROM dual WHERE day >= DATE '2000-08-01'")
def _(spark, folder):
    return windows.last_year(dual(spark, folder), "2001-08-06").select("player", "match_num")


@query("f25_monthly_rank", "dual", """
SELECT player, month, last_value(rank IGNORE NULLS) OVER (PARTITION BY player ORDER BY month ROWS UNBOUNDED PRECEDING) AS rank FROM (
  SELECT p.player, CAST(m.month AS DATE) AS month, r.rank FROM (SELECT DISTINCT player FROM dual) p
  CROSS JOIN (SELECT unnest(range(DATE '2000-09-01', DATE '2001-09-01', INTERVAL 1 MONTH)) AS month) m
  LEFT JOIN (SELECT player, date_trunc('month', day) AS month, arg_max(player_rank, tourney_date * 10000000000 + match_num) AS rank
    FROM dual WHERE player_rank IS NOT NULL AND day >= DATE '2000-08-01' GROUP BY 1, 2) r ON r.player = p.player AND r.month = m.month)
""")
def _(spark, folder):
    return windows.monthly_rank(dual(spark, folder), "2001-08-06").select("player", "month", "rank")


@query("f26_cumulative_meetings", "matches", """
SELECT least(winner_name, loser_name) AS player_one, greatest(winner_name, loser_name) AS player_two, match_num,
  row_number() OVER w AS meeting, CAST(sum(CAST(winner_name < loser_name AS INTEGER)) OVER w AS BIGINT) AS player_one_wins,
  CAST(sum(CAST(winner_name > loser_name AS INTEGER)) OVER w AS BIGINT) AS player_two_wins
FROM matches WINDOW w AS (PARTITION BY least(winner_name, loser_name), greatest(winner_name, loser_name) ORDER BY tourney_date, match_num ROWS UNBOUNDED PRECEDING)
""")
def _(spark, folder):
    df = match_table(spark, folder).select("winner_name", "loser_name", "tourney_date", "match_num")
    return windows.cumulative_meetings(df).select(
        "player_one", "player_two", "match_num", "meeting", "player_one_wins", "player_two_wins")


@query("f27_last_ten", "recent", "SELECT player, match_num, CAST(back AS INTEGER) AS recent_no FROM recent WHERE back <= 10")
def _(spark, folder):
    return newest(dual(spark, folder), ["player"], ["tourney_date", "match_num"], 10).select("player", "match_num", "recent_no")


# ---- F33, D13 ---------------------------------------------------------------------------------

cte("prev_year", ("steps_in",), """
SELECT *, coalesce(serve_pct - avg(serve_pct) OVER (PARTITION BY player ORDER BY day RANGE BETWEEN INTERVAL 730 DAYS PRECEDING AND INTERVAL 366 DAYS PRECEDING), 0.0) AS diff FROM steps_in
""")


@query("f33_raw_sequence_inputs", "prev_year", """
SELECT player, match_num, round(serve_pct, 6) + 0.0 AS raw_serve_pct, round(diff, 6) + 0.0 AS raw_serve_diff_prev_year,
  round(player_rank_norm, 6) + 0.0 AS raw_player_rank_norm, round(opp_rank_norm, 6) + 0.0 AS raw_opponent_rank_norm FROM prev_year
""")
def _(spark, folder):
    df = legacy.with_raw_sequences(served(spark, folder))
    return rounded(df, ["player", "match_num"], list(legacy.RAW_STEP))


@query("d13_joined_sequences", "stepped strict prev_year", """
SELECT s.player, s.match_num, CAST(10 - m + k AS INTEGER) AS step, round(short, 6) + 0.0 AS adj_serve_short_decay,
  round(q.sp, 6) + 0.0 AS raw_serve_pct, round(q.diff, 6) + 0.0 AS raw_serve_diff_prev_year
FROM stepped s JOIN (
  SELECT a.player, a.match_num, unnest(range(1, len(h) + 1)) AS k, unnest(h).sp AS sp, unnest(h).diff AS diff FROM dual a JOIN (
    SELECT player, tourney_date, hist[greatest(len(hist) - 9, 1):] AS h FROM (
      SELECT player, tourney_date, list({'sp': serve_pct, 'diff': diff}) OVER (PARTITION BY player ORDER BY tourney_date, match_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist
      FROM prev_year QUALIFY row_number() OVER (PARTITION BY player, tourney_date ORDER BY match_num) = 1)) b USING (player, tourney_date)
) q USING (player, match_num, k)
""")
def _(spark, folder):
    df = legacy.with_raw_sequences(legacy.with_sequences(step_inputs(spark, folder)))
    both = sequences.joined_sequences(df, "sequence", "mask", "raw_sequence", "raw_mask", sequences.RANK_STEP, legacy.RAW_STEP)
    steps = both.select("player", "match_num", F.posexplode(F.arrays_zip(
        F.col("sequence").alias("s"), F.col("mask").alias("m"))).alias("i", "x")).filter("x.m > 0")
    return rounded(steps.select("player", "match_num", (F.col("i") + 1).alias("step"), "x.s.*"), ["player", "match_num", "step"],
                   ["adj_serve_short_decay", "raw_serve_pct", "raw_serve_diff_prev_year"])


_STATIC = list(legacy.STATIC)


@query("legacy_static_features", "steps_in stepped", """
SELECT a.player, a.match_num, round(player_rank_norm, 6) + 0.0 AS player_rank_norm, round(opp_rank_norm, 6) + 0.0 AS opponent_rank_norm,
  round(player_rank_norm - opp_rank_norm, 6) + 0.0 AS rank_diff,
  CAST(count(*) OVER (PARTITION BY a.player ORDER BY a.tourney_date RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) AS career_matches_prior,
  a.days_since_prev, round(ln(1 + a.days_since_prev), 6) + 0.0 AS days_since_prev_log,
  round(coalesce(medium, 0.0), 6) + 0.0 AS recent_weighted_serve, round(coalesce(short - medium, 0.0), 6) + 0.0 AS form_delta_serve
FROM steps_in a LEFT JOIN (SELECT player, match_num, short, medium FROM stepped WHERE k = m) s ON a.player = s.player AND a.match_num = s.match_num
""")
def _(spark, folder):
    df = legacy.with_static(legacy.with_sequences(step_inputs(spark, folder)))
    return rounded(df, ["player", "match_num"], _STATIC)
