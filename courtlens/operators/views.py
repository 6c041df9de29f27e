"""Player, pair and tournament views over the match tables."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.functions import categories, dates, names, ranks, rates
from courtlens.operators import orient
from courtlens.operators.timeline import newest, one_per_key

ORDER = ("tourney_date", "match_num")


# ---- single rows ----------------------------------------------------------------------------


def without_team_cups(df: DataFrame) -> DataFrame:
    cup = F.col("tourney_name").contains("United Cup") | F.col("tourney_name").contains("Davis Cup")
    return df.filter((F.col("tourney_level") != "D") & ~cup)


def with_default_context(df: DataFrame) -> DataFrame:
    defaults = {"surface": "Hard", "round": "F", "tourney_level": "M", "tourney_id": "unknown",
                "tourney_name": "unknown"}
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def recent_match_rows(df: DataFrame) -> DataFrame:
    """Displayable rows with serve/return shares and the values adjusted for this opponent."""
    shown = orient.displayable(df)
    base = shown.withColumns({
        "serve_pct": rates.serve_pct("player"),
        "return_pct": rates.return_pct("opp"),
        "opponent_serve_pct": rates.share_or_null(
            F.col("opp_1stWon") + F.col("opp_2ndWon"), F.col("opp_svpt")),
        "opponent_return_pct": rates.share_or_null(
            F.col("player_svpt") - F.col("player_1stWon") - F.col("player_2ndWon"), F.col("player_svpt")),
    })
    return base.withColumns({
        "adjusted_serve": F.col("serve_pct") - F.col("opponent_return_pct"),
        "adjusted_return": F.col("return_pct") - F.col("opponent_serve_pct"),
    })


# ---- players --------------------------------------------------------------------------------


def latest_player_records(df: DataFrame) -> DataFrame:
    """One row per slug with name and attributes of its newest row: spellings of one slug are one
    player. Rows are reduced per spelling first, so slugs are made for few of them."""
    at = F.struct(*ORDER)
    newest_row = F.max_by(F.struct("player_ioc", "player_hand", "player_ht", "player_rank", "tourney_date"), at)
    spelled = df.groupBy("player").agg(newest_row.alias("r"), F.max(at).alias("at"))
    players = spelled.groupBy(names.slug(F.col("player")).alias("slug")).agg(F.max_by(F.struct(F.col("player").alias("name"), "r"), F.struct("at", "player")).alias("p"))
    return players.select(
        "slug", "p.name", F.col("p.r.player_ioc").alias("country"), F.col("p.r.player_hand").alias("handedness"),
        F.col("p.r.player_ht").cast("int").alias("height_cm"), F.col("p.r.player_rank").cast("int").alias("last_rank"),
        dates.as_date(F.col("p.r.tourney_date")).alias("last_rank_date"))


def search_players(records: DataFrame, text: str | None, limit: int) -> DataFrame:
    """Players whose name contains ``text``, best rank first (unranked count as 9999)."""
    hits = records if not text else records.filter(F.lower("name").contains(text.lower()))
    rank = F.coalesce(F.nullif(F.col("last_rank"), F.lit(0)), F.lit(9999))
    return hits.orderBy(rank, "name").limit(limit)


def player_by_slug(records: DataFrame, slug: str) -> DataFrame:
    return records.filter(F.col("slug") == slug)


def story(df: DataFrame, level: str = "M") -> DataFrame:
    """Per player: share of better-ranked matches (last 10 and at one level), opposition, serve spread."""
    better = F.coalesce((F.col("player_rank") < F.col("opponent_rank")).cast("double"), F.lit(0.0))
    base = df.withColumns({"_better": better, "serve_pct": rates.serve_pct("player")})
    last_ten = newest(base, ["player"], ORDER, 10).groupBy("player").agg(
        F.avg("_better").alias("better_ranked_share"),
        F.avg("opponent_rank").alias("mean_opponent_rank"),
        F.stddev_pop("serve_pct").alias("serve_spread"),
    )
    at_level = base.filter(F.col("tourney_level") == level).groupBy("player").agg(
        F.avg("_better").alias("level_better_ranked_share"))
    return last_ten.join(at_level, "player", "left").fillna(0.0, ["level_better_ranked_share"])


def pair_story(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """The four story metrics of both players of every requested pair, one row per metric."""
    per_player = story(df)
    labels = [
        ("Rolling form (last 10)", "better_ranked_share", "win %"),
        ("Masters win %", "level_better_ranked_share", "win %"),
        ("Avg opponent rank (10 matches)", "mean_opponent_rank", "rank"),
        ("Serve consistency index", "serve_spread", "std"),
    ]
    packed = per_player.select("player", F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(c).alias("value"), F.lit(unit).alias("unit"))
        for label, c, unit in labels
    ]).alias("m"))
    one = packed.select(F.col("player").alias("player_one"), F.col("m").alias("m1"))
    two = packed.select(F.col("player").alias("player_two"), F.col("m").alias("m2"))
    both = pairs.join(one, "player_one").join(two, "player_two")
    return both.select("player_one", "player_two", F.inline(F.arrays_zip("m1", "m2"))).select(
        "player_one", "player_two", F.col("m1.label").alias("label"), F.col("m1.value").alias("player_one_value"),
        F.col("m2.value").alias("player_two_value"), F.col("m1.unit").alias("unit"))


def form_profile(df: DataFrame) -> DataFrame:
    """Last ten: win rate, serve, return, opposition quality and top-10 win share, in percent."""
    rank = F.coalesce(F.nullif(F.col("opponent_rank"), F.lit(0.0)), F.lit(1000.0))
    top = F.count_if(rank <= 10)
    return newest(df, ["player"], ORDER, 10).groupBy("player").agg(
        (F.avg(F.col("label").cast("double")) * 100).alias("win_rate"),
        (F.avg("serve_pct") * 100).alias("serve_avg"), (F.avg("return_pct") * 100).alias("return_avg"),
        F.greatest(F.lit(0.0), 100 - F.avg(rank) / 20).alias("opponent_quality"),
        (F.count_if((F.col("label") == 1) & (rank <= 10)) / F.greatest(top, F.lit(1)) * 100).alias("top10_wins"),
    )


def box_plot(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """Box-plot numbers of the newest matches; quartiles are ``sorted[floor(n * q)]``."""
    picked = newest(df.filter(F.col(value).isNotNull()), ["player"], ORDER, n)
    grouped = picked.groupBy("player").agg(
        F.array_sort(F.collect_list(value)).alias("v"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_dev"))

    def at(q: float) -> Column:
        return F.element_at("v", (F.floor(F.size("v") * q) + 1).cast("int"))

    return grouped.select("player", F.array_min("v").alias("min"), at(0.25).alias("q1"), at(0.5).alias("median"),
                          at(0.75).alias("q3"), F.array_max("v").alias("max"), "mean", "std_dev")


# ---- win shares -----------------------------------------------------------------------------


def win_share(df: DataFrame, by: Sequence[str | Column], *more: Column) -> DataFrame:
    """Matches, wins and win percentage per group; counts are combined before the shuffle."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matches"), F.sum("label").cast("bigint").alias("wins"),
        (F.avg(F.col("label").cast("double")) * 100).alias("win_pct"), *more)


def by_surface(df: DataFrame) -> DataFrame:
    mean_serve = (F.avg(F.coalesce("serve_pct", F.lit(0.0))) * 100).alias("serve_avg")
    return win_share(df.filter(F.col("surface").isin(*categories.ONE_HOT_SURFACES)), ["player", "surface"], mean_serve)


def by_rank_bucket(df: DataFrame, buckets, unranked: str | None = None) -> DataFrame:
    labelled = df.withColumn("bucket", ranks.bucket_of(F.col("opponent_rank"), buckets, unranked))
    return win_share(labelled.filter(F.col("bucket").isNotNull()), ["player", "bucket"])


def recent_and_career(df: DataFrame, buckets) -> DataFrame:
    """Win share per bucket over the last ten matches and over all."""
    career = by_rank_bucket(df, buckets).select("player", "bucket", F.col("win_pct").alias("career_win_pct"))
    recent = by_rank_bucket(newest(df, ["player"], ORDER, 10), buckets).select(
        "player", "bucket", F.col("win_pct").alias("recent_win_pct"))
    return career.join(recent, ["player", "bucket"], "left")


def by_round(df: DataFrame, rounds: Sequence[str], surface: str | None = None) -> DataFrame:
    rows = df.filter(F.col("round").isin(*rounds))
    if surface:
        rows = rows.filter(F.col("surface") == surface)
    return win_share(rows, ["player", "round"])


def by_tier(df: DataFrame) -> DataFrame:
    return win_share(df.withColumn("tier", categories.tier_group(F.col("tourney_name"))).filter("tier IS NOT NULL"),
                     ["player", "tier"])


def tier_counts(df: DataFrame) -> DataFrame:
    tier = categories.tier_from_event(F.col("tourney_name"))
    named = df.withColumn("tier", tier).groupBy("player", "tier").agg(F.count(F.lit(1)).alias("matches"))
    return named.withColumn("tier_name", categories.lookup(F.col("tier"), categories.TIER_NAMES, F.col("tier")))


def tier_union(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tiers either player of a pair has played, with both counts (0 where absent)."""
    one = pairs.join(counts.withColumnRenamed("player", "player_one"), "player_one").select(
        "player_one", "player_two", "tier", F.col("matches").alias("m1"), F.lit(0).cast("bigint").alias("m2"))
    two = pairs.join(counts.withColumnRenamed("player", "player_two"), "player_two").select(
        "player_one", "player_two", "tier", F.lit(0).cast("bigint").alias("m1"), F.col("matches").alias("m2"))
    return one.unionByName(two).groupBy("player_one", "player_two", "tier").agg(
        F.sum("m1").alias("player_one_matches"), F.sum("m2").alias("player_two_matches"))


# ---- pairs ----------------------------------------------------------------------------------


def meetings(df: DataFrame, since: int = 20180101) -> DataFrame:
    """Finished meetings per unordered pair since a date, each real match once.

    ``df`` is the two-sided table; rows are collapsed by match id, the last one wins.
    """
    score = F.coalesce(F.lower("score"), F.lit(""))
    rows = df.filter((F.col("tourney_date") >= since) & ~score.rlike("w/o|ret")).withColumns({
        "player_one": F.least("player", "opponent"), "player_two": F.greatest("player", "opponent")})
    single = one_per_key(rows, ["match_id"], [F.col("tourney_date").desc(), F.col("match_num").desc(), F.col("player")])
    return single.withColumn("player_one_win", (F.col("winner_name") == F.col("player_one")).cast("int"))


def head_to_head(met: DataFrame) -> DataFrame:
    return met.groupBy("player_one", "player_two").agg(
        F.count(F.lit(1)).alias("total_matches"), F.sum("player_one_win").alias("player_one_wins"),
        F.sum(1 - F.col("player_one_win")).alias("player_two_wins"))


def head_to_head_by_surface(met: DataFrame) -> DataFrame:
    return met.filter(F.col("surface").isNotNull()).groupBy("player_one", "player_two", "surface").agg(
        F.sum("player_one_win").cast("double").alias("player_one_value"),
        F.sum(1 - F.col("player_one_win")).cast("double").alias("player_two_value"))


def latest_sample(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest row of the canonical orientation for each requested pair; ``swapped`` says the request is reversed."""
    canonical = df.filter(F.col("player") <= F.col("opponent")).groupBy("player", "opponent").agg(
        F.max_by(F.struct("match_id", "tourney_date", "match_num"), F.struct(*ORDER)).alias("s"))
    asked = requests.withColumns({
        "player": F.least("player_one", "player_two"), "opponent": F.greatest("player_one", "player_two"),
        "swapped": F.col("player_one") > F.col("player_two")})
    return asked.join(canonical, ["player", "opponent"]).select(
        "player_one", "player_two", "swapped", "s.match_id", "s.tourney_date", "s.match_num")


def latest_sample_by_name(df: DataFrame, requests: DataFrame) -> DataFrame:
    """As ``latest_sample`` but by trimmed lower-case names, the requested orientation first."""
    def key(c):
        return F.lower(F.trim(F.col(c)))

    latest = df.groupBy(key("player").alias("a"), key("opponent").alias("b")).agg(
        F.max_by(F.struct("match_id", "tourney_date", "match_num"), F.struct(*ORDER)).alias("s"))
    asked = requests.withColumns({"a": key("player_one"), "b": key("player_two")})
    direct = latest.withColumnRenamed("s", "direct")
    reverse = latest.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("s").alias("reverse"))
    found = asked.join(direct, ["a", "b"], "left").join(reverse, ["a", "b"], "left")
    picked = F.coalesce("direct", "reverse")
    return found.filter(picked.isNotNull()).select(
        "player_one", "player_two", F.col("direct").isNull().alias("swapped"),
        picked.match_id.alias("match_id"), picked.match_num.alias("match_num"))


def side_by_side(recent: DataFrame, pairs: DataFrame, fields: Sequence[str], n: int = 10) -> DataFrame:
    """Two players' newest matches aligned by index, oldest first; missing ones stay null."""
    rows = newest(recent, ["player"], ORDER, n)
    index = F.row_number().over(Window.partitionBy("player").orderBy(*ORDER))
    # at most n entries per player
    lists = rows.select("player", F.struct(index.alias("i"), *fields).alias("m")).groupBy("player").agg(
        F.array_sort(F.collect_list("m")).alias("m"))
    one = lists.select(F.col("player").alias("player_one"), F.col("m").alias("one"))
    two = lists.select(F.col("player").alias("player_two"), F.col("m").alias("two"))
    zipped = pairs.join(one, "player_one", "left").join(two, "player_two", "left").select(
        "player_one", "player_two",
        F.posexplode(F.arrays_zip(F.coalesce("one", F.array()).alias("one"), F.coalesce("two", F.array()).alias("two"))))
    return zipped.select(
        "player_one", "player_two", (F.col("pos") + 1).alias("match_index"),
        *[F.col(f"col.one.{f}").alias(f"one_{f}") for f in fields],
        *[F.col(f"col.two.{f}").alias(f"two_{f}") for f in fields])


# ---- tournaments ----------------------------------------------------------------------------

TOURNAMENT = ("tourney_name", "year_month")


def tournament_matches(predictions: DataFrame) -> DataFrame:
    """Prediction rows with their tournament key, team cups left out."""
    return without_team_cups(predictions).withColumn("year_month", dates.year_month(F.col("tourney_date")))


def tournaments(rows: DataFrame) -> DataFrame:
    """One row per name and month: first id, level, surface, dates, matches and accuracy (ties count for player one)."""
    guess = F.when(F.col("prob_two") > F.col("prob_one"), "player_two").otherwise("player_one")
    first = F.struct("match_num")
    return rows.groupBy(*TOURNAMENT).agg(
        F.min_by("tourney_id", first).alias("tournament_id"),
        F.min_by("tourney_level", first).alias("tournament_level"),
        F.coalesce(F.min_by("surface", first), F.lit("Hard")).alias("surface"),
        F.min("tourney_date").alias("start_date"), F.max("tourney_date").alias("end_date"),
        F.count(F.lit(1)).alias("matches"),
        F.avg((guess == F.col("actual_winner")).cast("double")).alias("accuracy"))


def round_rows(rows: DataFrame) -> DataFrame:
    """Matches of the drawn rounds with the round's place; other rounds are dropped."""
    place = categories.code_of(F.coalesce("round", F.lit("F")), (*categories.DRAW_ROUNDS, "?"))
    return rows.withColumn("round", F.coalesce("round", F.lit("F"))).withColumn("round_no", place).filter(
        F.col("round_no") < len(categories.DRAW_ROUNDS))


def round_sizes(rows: DataFrame) -> DataFrame:
    return round_rows(rows).groupBy(*TOURNAMENT, "round_no", "round").agg(F.count(F.lit(1)).alias("matches"))


def tournament_list(events: DataFrame) -> DataFrame:
    """Grouped list: one entry per name and start date, known tiers only; sort it where it is shown."""
    group = categories.lookup(F.col("tournament_level"), categories.LIST_GROUPS, F.lit(None).cast("string"))
    single = one_per_key(events, ["tourney_name", "start_date"], [F.col("tournament_id"), F.col("year_month")])
    return single.withColumn("tier", group).filter("tier IS NOT NULL")
