"""Match tables built from the order tables, so every operator can run on given data.

Suppliers act as players and each order as one match. Integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtlens.operators.timeline import global_position

# Event names by customer key.
EVENTS = (
    "Australian Open", "Wimbledon", "US Open", "Miami Masters", "Rome Masters", "Dubai ATP500",
    "Basel ATP500", "Lyon ATP250", "Davis Cup Finals", "United Cup", "Prague Challenger",
    "Nitto ATP Finals", "Cincinnati ATP1000",
)


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def players(spark: SparkSession, folder: str) -> DataFrame:
    supplier = _read(spark, folder, "supplier")
    nation = _read(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("ioc"))
    ranked = global_position(
        supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
        [F.col("s_acctbal").desc(), F.col("s_suppkey")],
        "rnk",
    )
    return (
        ranked.join(nation, ranked.s_nationkey == nation.n_nationkey, "left")
        .select(
            "s_suppkey", F.col("s_name").alias("name"), F.col("rnk").cast("double").alias("rnk"), "ioc",
            F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'L' WHEN s_suppkey % 13 = 0 THEN 'U' ELSE 'R' END").alias("hand"),
            F.expr("CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(170 + s_suppkey % 35 AS DOUBLE) END").alias("ht"),
        )
    )


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """One row per match with winner and loser columns."""
    how_many = _read(spark, folder, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    base = _read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("st"),
        F.to_date(F.date_trunc("week", "o_orderdate")).alias("d"), how_many.alias("n"),
    )
    counted = (
        base.withColumn("p1", F.expr("(k*7 + c) % n"))
        .withColumn("p2", F.expr("(p1 + 1 + (c*13 + k) % (n-1)) % n"))
        .withColumn("w_svpt", F.expr("CASE WHEN k % 53 = 0 THEN 0 ELSE 50 + (k*31+c) % 60 END"))
        .withColumn("l_svpt", F.expr("50 + (k*17+c*3) % 60"))
        .withColumn("w_1stIn", F.expr("CAST(floor(w_svpt*6/10) AS BIGINT)"))
        .withColumn("l_1stIn", F.expr("CAST(floor(l_svpt*6/10) AS BIGINT)"))
    )
    who = players(spark, folder)
    winner = who.select(*[F.col(c).alias(f"winner_{c}") for c in who.columns])
    loser = who.select(*[F.col(c).alias(f"loser_{c}") for c in who.columns])
    names = F.array(*[F.lit(e) for e in EVENTS])
    day = F.date_format("d", "yyyyMMdd")
    return (
        counted.join(winner, F.col("p1") == F.col("winner_s_suppkey"))
        .join(loser, F.col("p2") == F.col("loser_s_suppkey"))
        .select(
            day.cast("int").alias("tourney_date"),
            F.concat(day, F.lit("-"), "st").alias("tourney_id"),
            F.element_at(names, (F.col("c") % len(EVENTS) + 1).cast("int")).alias("tourney_name"),
            F.col("k").alias("match_num"), "winner_name", "loser_name",
            F.expr("CASE WHEN k % 29 = 0 THEN NULL ELSE winner_rnk END").alias("winner_rank"),
            F.col("loser_rnk").alias("loser_rank"),
            "winner_ioc", "loser_ioc", "winner_hand", "loser_hand", "winner_ht", "loser_ht",
            F.expr("CASE pr WHEN '1-URGENT' THEN 'Hard' WHEN '2-HIGH' THEN 'Clay' "
                   "WHEN '3-MEDIUM' THEN 'Grass' WHEN '4-NOT SPECIFIED' THEN 'Carpet' END").alias("surface"),
            F.expr("CASE st WHEN 'F' THEN 'G' WHEN 'O' THEN 'M' ELSE 'B' END").alias("tourney_level"),
            F.expr("CASE k % 7 WHEN 0 THEN 'R128' WHEN 1 THEN 'R64' WHEN 2 THEN 'R32' WHEN 3 THEN 'R16' "
                   "WHEN 4 THEN 'QF' WHEN 5 THEN 'SF' ELSE 'F' END").alias("round"),
            F.expr("CASE WHEN k % 37 = 0 THEN 'W/O' WHEN k % 41 = 0 THEN '6-3 2-1 RET' ELSE '6-4 6-4' END").alias("score"),
            F.expr("(k+c) % 15").alias("w_ace"), F.expr("(k+c) % 6").alias("w_df"), "w_svpt", "w_1stIn",
            F.expr("CAST(floor(w_1stIn*(60+k%30)/100) AS BIGINT)").alias("w_1stWon"),
            F.expr("CAST(floor((w_svpt-w_1stIn)*(40+k%30)/100) AS BIGINT)").alias("w_2ndWon"),
            F.expr("8 + k % 6").alias("w_SvGms"),
            F.expr("CAST(floor((c%10)*(k%11)/10) AS BIGINT)").alias("w_bpSaved"), F.expr("c % 10").alias("w_bpFaced"),
            F.expr("(k+2*c) % 15").alias("l_ace"), F.expr("(k+2*c) % 6").alias("l_df"), "l_svpt", "l_1stIn",
            F.expr("CAST(floor(l_1stIn*(55+k%30)/100) AS BIGINT)").alias("l_1stWon"),
            F.expr("CAST(floor((l_svpt-l_1stIn)*(35+k%30)/100) AS BIGINT)").alias("l_2ndWon"),
            F.expr("8 + c % 6").alias("l_SvGms"),
            F.expr("CAST(floor((k%10)*(c%11)/10) AS BIGINT)").alias("l_bpSaved"), F.expr("k % 10").alias("l_bpFaced"),
        )
    )


def odds(spark: SparkSession, folder: str) -> DataFrame:
    """Bookmaker odds per match, in winner/loser order."""
    return _read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("match_num"),
        (F.lit(1.2) + (F.col("o_orderkey") % 40) / 40.0).alias("odds_winner"),
        (F.lit(1.2) + ((F.col("o_orderkey") + 17) % 40) / 40.0).alias("odds_loser"),
    )


HEADER = "Date\tTournament\tSurface\tRd\tRk\tvRk\t\tScore\tDR\tA%\tDF%\t1stIn\t1st%\t2nd%\tBPSvd\tTime"


def pasted_texts(two_sided: DataFrame) -> DataFrame:
    """Every match of every player as a line of pasted text: one text per player and year, newest
    first, half of the players with a header line. A year bounds how many lines a text can have."""
    from courtlens.functions.dates import as_date

    def percent(num: str, den: str) -> str:
        x = f"((1000*{num}) div {den})"
        return f"CASE WHEN {den} <= 0 THEN '' ELSE concat({x} div 10, '.', {x} % 10, '%') END"

    ratio = "((100*(player_1stWon+player_2ndWon)*opp_svpt) div (player_svpt*(opp_1stWon+opp_2ndWon)))"
    own = "coalesce(cast(cast(player_rank as int) as string), '-')"
    other = "coalesce(cast(cast(opponent_rank as int) as string), '-')"
    verb = "CASE WHEN match_num % 23 = 0 THEN ' vs ' ELSE ' d. ' END"
    me, you = f"concat('(', {own}, ')', player)", f"concat('(', {other}, ')', opponent)"
    parts = [
        "day_text", "tourney_name", "coalesce(surface, '')", "round", own, other,
        f"CASE WHEN label = 1 THEN concat({me}, {verb}, {you}, ' [FRA]') ELSE concat({you}, ' [ESP]', {verb}, {me}) END",
        "score",
        f"CASE WHEN player_svpt*(opp_1stWon+opp_2ndWon) = 0 THEN '' ELSE concat({ratio} div 100, '.', lpad(cast({ratio} % 100 as string), 2, '0')) END",
        percent("player_ace", "player_svpt"), percent("player_df", "player_svpt"), percent("player_1stIn", "player_svpt"),
        percent("player_1stWon", "player_1stIn"), percent("player_2ndWon", "(player_svpt-player_1stIn)"),
        "concat(player_bpSaved, '/', player_bpFaced)", "'1:45'",
    ]
    rows = two_sided.withColumn("day_text", F.date_format(as_date(F.col("tourney_date")), "dd-MMM-yyyy"))
    lined = rows.select(
        "player", F.expr("tourney_date div 10000").alias("year"), (-F.col("tourney_date")).alias("newest"), (-F.col("match_num")).alias("last"),
        F.expr(f"concat_ws('\\t', {', '.join(parts)})").alias("line"))
    texts = lined.groupBy("player", "year").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("newest", "last", "line"))), lambda x: x.line), "\n").alias("body"))
    return texts.select(
        F.expr("cast(substr(player, 10) as bigint) * 10000 + year").alias("doc_id"), F.col("player").alias("player_name"),
        F.when(F.expr("cast(substr(player, -1) as int) % 2 = 0"), F.concat(F.lit(HEADER + "\n"), "body")).otherwise(F.col("body")).alias("text"))
