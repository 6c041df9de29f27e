"""Query registry and the shared SQL building blocks of the checking queries."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtlens.operators import orient
from courtlens.session import passing, tidy
from courtlens.sources import derived, tables

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body.strip())


def _ordered(name: str, seen: list[str]) -> None:
    needs, _ = CTES[name]
    for need in needs:
        _ordered(need, seen)
    if name not in seen:
        seen.append(name)


def with_ctes(needs: str, body: str) -> str:
    """``body`` preceded by the named building blocks and whatever they need."""
    seen: list[str] = []
    for name in needs.split():
        _ordered(name, seen)
    parts = ",\n".join(f"{n} AS (\n{CTES[n][1]}\n)" for n in seen)
    body = body.strip()
    if not parts:
        return body
    start = "WITH RECURSIVE" if any(n.endswith("paths") for n in seen) else "WITH"
    if body.startswith("WITH "):
        return f"{start} {parts},\n{body[5:]}"
    return f"{start} {parts}\n{body}"


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a query and, where SQL can express it, its checking statement."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in RUNS:
            raise ValueError(f"duplicate query {name}")
        RUNS[name] = run
        if sql is not None:
            SQL[name] = with_ctes(needs, sql)
        return run

    return register


def r6(value: Column | str) -> Column:
    """Rounded so that two engines that add in another order agree."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, keep: list[str], numbers: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in numbers])


def sql_r6(*names: str) -> str:
    return ", ".join(f'round(CAST("{n}" AS DOUBLE), 6) + 0.0 AS "{n}"' for n in names)


# ---- tables every family starts from -------------------------------------------------------

_STORED: dict[tuple[str, str], str] = {}


def match_table(spark: SparkSession, folder: str) -> DataFrame:
    """The match table of a data folder, derived once per application and then read as Parquet.

    It is stored in the shared folder, so every query prunes its columns at the scan instead of
    joining the order tables again.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        place = tables.shared_folder(spark, "matches")
        with passing(spark), tidy(spark):
            derived.matches(spark, folder).write.parquet(place)
        _STORED[key] = place
    return spark.read.parquet(_STORED[key])


def dual(spark: SparkSession, folder: str, *carry: str) -> DataFrame:
    """Two-sided table carrying only the match columns asked for."""
    keep = list(dict.fromkeys(["tourney_date", "match_num", *carry]))
    return orient.two_sided(match_table(spark, folder), keep)


def player_table(spark: SparkSession, folder: str, *carry: str) -> DataFrame:
    """Two-sided table with ``player_*`` / ``opp_*`` statistics and the surface."""
    return orient.to_player_columns(dual(spark, folder, "surface", *carry))


cte("player_count", (), "SELECT count(*) AS n FROM supplier")
cte("who", (), """
SELECT s_suppkey, s_name AS name,
  CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS DOUBLE) AS rnk, n_name AS ioc,
  CASE WHEN s_suppkey % 3 = 0 THEN 'L' WHEN s_suppkey % 13 = 0 THEN 'U' ELSE 'R' END AS hand,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(170 + s_suppkey % 35 AS DOUBLE) END AS ht
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
""")
_EVENT_LIST = ", ".join(f"'{e}'" for e in derived.EVENTS)
cte("base_matches", ("player_count",), """
SELECT *, CAST(floor(w_svpt*6/10) AS BIGINT) AS w_1stIn, CAST(floor(l_svpt*6/10) AS BIGINT) AS l_1stIn
FROM (
  SELECT *, (p1 + 1 + (c*13 + k) % (n-1)) % n AS p2,
    CASE WHEN k % 53 = 0 THEN 0 ELSE 50 + (k*31+c) % 60 END AS w_svpt, 50 + (k*17+c*3) % 60 AS l_svpt
  FROM (
    SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS pr, o_orderstatus AS st,
      CAST(date_trunc('week', o_orderdate) AS DATE) AS d, n, (o_orderkey*7 + o_custkey) % n AS p1
    FROM orders CROSS JOIN player_count
  )
)
""")
cte("matches", ("who", "base_matches"), f"""
SELECT CAST(year(d)*10000+month(d)*100+day(d) AS INTEGER) AS tourney_date,
  concat(CAST(year(d)*10000+month(d)*100+day(d) AS VARCHAR),'-',st) AS tourney_id,
  list_extract([{_EVENT_LIST}], CAST(c % {len(derived.EVENTS)} + 1 AS BIGINT)) AS tourney_name,
  k AS match_num, w.name AS winner_name, l.name AS loser_name,
  CASE WHEN k % 29 = 0 THEN NULL ELSE w.rnk END AS winner_rank, l.rnk AS loser_rank,
  w.ioc AS winner_ioc, l.ioc AS loser_ioc, w.hand AS winner_hand, l.hand AS loser_hand,
  w.ht AS winner_ht, l.ht AS loser_ht,
  CASE pr WHEN '1-URGENT' THEN 'Hard' WHEN '2-HIGH' THEN 'Clay' WHEN '3-MEDIUM' THEN 'Grass' WHEN '4-NOT SPECIFIED' THEN 'Carpet' END AS surface,
  CASE st WHEN 'F' THEN 'G' WHEN 'O' THEN 'M' ELSE 'B' END AS tourney_level,
  CASE k % 7 WHEN 0 THEN 'R128' WHEN 1 THEN 'R64' WHEN 2 THEN 'R32' WHEN 3 THEN 'R16' WHEN 4 THEN 'QF' WHEN 5 THEN 'SF' ELSE 'F' END AS round,
  CASE WHEN k % 37 = 0 THEN 'W/O' WHEN k % 41 = 0 THEN '6-3 2-1 RET' ELSE '6-4 6-4' END AS score,
  (k+c) % 15 AS w_ace, (k+c) % 6 AS w_df, w_svpt, w_1stIn AS "w_1stIn",
  CAST(floor(w_1stIn*(60+k%30)/100) AS BIGINT) AS "w_1stWon",
  CAST(floor((w_svpt-w_1stIn)*(40+k%30)/100) AS BIGINT) AS "w_2ndWon", 8 + k % 6 AS "w_SvGms",
  CAST(floor((c%10)*(k%11)/10) AS BIGINT) AS "w_bpSaved", c%10 AS "w_bpFaced",
  (k+2*c) % 15 AS l_ace, (k+2*c) % 6 AS l_df, l_svpt, l_1stIn AS "l_1stIn",
  CAST(floor(l_1stIn*(55+k%30)/100) AS BIGINT) AS "l_1stWon",
  CAST(floor((l_svpt-l_1stIn)*(35+k%30)/100) AS BIGINT) AS "l_2ndWon", 8 + c % 6 AS "l_SvGms",
  CAST(floor((k%10)*(c%11)/10) AS BIGINT) AS "l_bpSaved", k%10 AS "l_bpFaced"
FROM base_matches JOIN who w ON w.s_suppkey = p1 JOIN who l ON l.s_suppkey = p2
""")


def _side_sql(own: str, other: str, long_own: str, long_other: str, label: int) -> str:
    stats = ", ".join(
        f'"{own}_{s}" AS player_{s}, "{other}_{s}" AS opp_{s}' for s in orient.USED_STATS
    )
    return (
        f"SELECT {long_own}_name AS player, {long_other}_name AS opponent, CAST({label} AS INTEGER) AS label, "
        f"{long_own}_rank AS player_rank, {long_other}_rank AS opponent_rank, {stats}, "
        f'"{own}_SvGms" AS player_SvGms, "{other}_SvGms" AS opp_SvGms, '
        f"{long_own}_ioc AS player_ioc, {long_own}_hand AS player_hand, {long_own}_ht AS player_ht, "
        "tourney_date, match_num, tourney_id, tourney_name, surface, round, score, winner_name, loser_name, "
        "CASE WHEN tourney_level IN ('B','500') THEN 'A' ELSE tourney_level END AS tourney_level, "
        "least(winner_name, loser_name) || '_' || greatest(winner_name, loser_name) || '_' || CAST(tourney_date AS VARCHAR) AS match_id, "
        "strptime(CAST(tourney_date AS VARCHAR), '%Y%m%d')::DATE AS day FROM matches"
    )


cte("dual", ("matches",),
    _side_sql("w", "l", "winner", "loser", 1) + "\nUNION ALL\n" + _side_sql("l", "w", "loser", "winner", 0))


def _ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0.0)"


cte("rates", ("dual",), f"""
SELECT *,
  {_ratio('player_1stIn', 'player_svpt')} AS player_1st_in_pct,
  {_ratio('player_1stWon', 'player_1stIn')} AS player_1st_win_pct,
  {_ratio('player_2ndWon', 'player_svpt - player_1stIn')} AS player_2nd_win_pct,
  {_ratio('player_ace', 'player_svpt')} AS player_ace_rate,
  {_ratio('player_df', 'player_svpt')} AS player_df_rate,
  {_ratio('player_bpSaved', 'player_bpFaced')} AS player_bp_save_pct,
  1.0 - {_ratio('opp_1stWon', 'opp_1stIn')} AS player_1st_return_win_pct,
  1.0 - {_ratio('opp_2ndWon', 'opp_svpt - opp_1stIn')} AS player_2nd_return_win_pct,
  1.0 - {_ratio('opp_bpSaved', 'opp_bpFaced')} AS player_bp_convert_pct,
  {_ratio('player_1stWon + player_2ndWon', 'player_svpt')} AS serve_pct,
  {_ratio('opp_svpt - opp_1stWon - opp_2ndWon', 'opp_svpt')} AS return_pct
FROM dual
""")
