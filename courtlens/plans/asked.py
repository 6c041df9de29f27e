"""Features of requested matches, fetched by key: each request finds its place, then a few rows.

A request looks up the career number that its player had reached before its date, from the players'
days alone. Only rows of the days that hold the thirty rows up to it are read with their values,
numbered and joined, so the work follows the requests, not the history. Two sources of features are
scored: the newest stored row of a pair (frozen) and the state as of the request's date (fresh).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.functions import rates
from courtlens.functions.categories import one_hot_surfaces
from courtlens.operators.asof import asof_join
from courtlens.operators.timeline import among, before_each_day
from courtlens.plans import features
from courtlens.plans.discriminant import FIELDS, MEAN, Model
from courtlens.plans.scoring import STYLE_INPUT, style_matchup
from courtlens.session import cut_lineage

LONGEST = 30
REQUEST = ("request_id", "player", "opponent", "tourney_date", "surface")
OK, NO_HISTORY, UNKNOWN = "ok", "no history before the match date", "unknown player"


def both_sides(requests: DataFrame) -> DataFrame:
    """Every request seen from either player; ``side`` is 1 for the player asked first."""
    turned = requests.select("request_id", F.col("opponent").alias("player"), F.col("player").alias("opponent"), "tourney_date", "surface")
    return requests.select(*REQUEST, F.lit(1).alias("side")).unionByName(turned.withColumn("side", F.lit(2)))


def career_days(history: DataFrame) -> DataFrame:
    """(player, day, _before, _through): how many rows the player had before and by the end of each day."""
    count = {"_n": F.count(F.lit(1))}
    days = before_each_day(history, ["player"], features.DAY, count, lambda w: {"_before": F.coalesce(F.sum("_n").over(w), F.lit(0)), "_n": F.col("_n")})
    return days.select("player", features.DAY, "_before", (F.col("_before") + F.col("_n")).alias("_through"))


def with_career_number(rows: DataFrame) -> DataFrame:
    """1 for a player's first row, 2 for the next, ...: rows of whole days, numbered within them after ``_before``."""
    inside = F.row_number().over(Window.partitionBy("player", features.DAY).orderBy("match_num"))
    number = F.when(F.col(features.DAY).isNotNull(), F.col("_before") + inside)
    return rows.withColumn("career_no", number).drop("_before")


def request_values(history: DataFrame, sides: DataFrame, model: Model) -> DataFrame:
    """Window means, the nine static values (not scaled), steps and status for each side of each request.

    ``history`` is the feature table. A player who is not in it is unknown; one without a row before
    the date has no history; both keep zeros.
    """
    named = sides.select("player").union(sides.select("opponent")).distinct()
    known = history.select("player").distinct().join(named, "player", "left_semi").withColumn("_known", F.lit(True))
    days = cut_lineage(career_days(history.select("player", features.DAY).join(named, "player", "left_semi")))
    dated = days.withColumn("career_no", F.when(F.col(features.DAY).isNotNull(), F.col("_through"))).withColumn("_one", F.lit(1))
    ends = sides.select("player", features.DAY).union(sides.select("opponent", features.DAY)).distinct()
    ends = cut_lineage(asof_join(ends, dated, left_key="player", right_key="player", day=features.DAY, number="_one",
                                 values=["career_no", "_through"], prefix="_", mode="before"))
    placed = sides.join(ends.drop("__through"), ["player", features.DAY], "left")
    reached = ends.select("player", F.col("__through").alias("_reached")).where("_reached IS NOT NULL").distinct()
    near = (F.col("_before") < F.col("_reached")) & (F.col("_through") > F.col("_reached") - LONGEST)
    wanted_days = cut_lineage(days.join(reached, "player").where(near).select("player", features.DAY, "_before").distinct())
    own = cut_lineage(with_career_number(model.styles.add(among(history, wanted_days, ["player", features.DAY]))))
    faced = asof_join(placed, own, left_key="opponent", right_key="player", day=features.DAY, number="match_num",
                      values=["serve_skill", "return_skill", "player_style_cluster"], prefix="_opp_", mode="before")
    wanted = placed.where("_career_no IS NOT NULL").select(
        "request_id", "side", "player", "_career_no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_career_no") - (LONGEST - 1)), F.col("_career_no"))).alias("career_no"))
    rows = wanted.join(own.drop(features.DAY, "label"), ["player", "career_no"])
    state = rows.groupBy("request_id", "side").agg(*_state())
    joined = faced.join(state, ["request_id", "side"], "left")
    joined = joined.join(known, "player", "left").join(known.toDF("opponent", "_opp_known"), "opponent", "left")
    return _with_values(model.styles.add(joined, "_style"))


def _state() -> list[Column]:
    newest = F.col("_career_no") - F.col("career_no") < features.SEQ_LEN
    ten = lambda c: F.avg(F.when(newest, c))
    window = {MEAN + f: ten(rates.finite_or_zero(F.col(f))) for f in features.SEQUENCE_FEATURES}
    mean = {r: ten(F.col(r)) for r in features.ROLLED}
    serve = rates.serve_skill(mean["player_1st_win_pct"], mean["player_2nd_win_pct"], mean["player_ace_rate"], mean["player_df_rate"])
    ret = rates.return_skill(mean["player_1st_return_win_pct"], mean["player_2nd_return_win_pct"])
    long = {c: F.avg(c.removesuffix("_roll30")) for c in STYLE_INPUT}
    return [F.count(F.when(newest, 1)).alias("steps"), serve.alias("serve_skill"), ret.alias("return_skill"),
            *[v.alias(n) for n, v in {**window, **long}.items()]]


def _with_values(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    ready = df.withColumns({
        **{s: F.coalesce(s, zero) for s in ("serve_skill", "return_skill", "_opp_serve_skill", "_opp_return_skill")},
        **{f: F.coalesce(f, zero) for f in FIELDS}, **one_hot_surfaces(F.coalesce("surface", F.lit("Hard"))),
        "player_style_cluster": F.when(F.col("steps") > 0, F.col("_style")).otherwise(0),
        "opp_style_cluster": F.coalesce("_opp_player_style_cluster", F.lit(0)), "steps": F.coalesce("steps", F.lit(0)).cast("int"),
        "status": F.when(F.col("_known").isNull() | F.col("_opp_known").isNull(), UNKNOWN).when(F.col("steps") > 0, OK).otherwise(NO_HISTORY)})
    edged = ready.withColumns({
        "serve_vs_return_edge": F.col("serve_skill") - F.col("_opp_return_skill"),
        "return_vs_serve_edge": F.col("return_skill") - F.col("_opp_serve_skill"),
        "style_matchup": style_matchup(F.col("player_style_cluster"), F.col("opp_style_cluster"))})
    full = edged.withColumn("net_edge", F.col("serve_vs_return_edge") + F.col("return_vs_serve_edge"))
    static = [rates.finite_or_zero(F.col(s).cast("double")).alias(s) for s in features.STATIC_FEATURES]
    return full.select(*REQUEST, "side", *FIELDS, *static, "steps", "status")


def both_ways(scored: DataFrame) -> DataFrame:
    """(request_id, prob_one, status): the first player's probability, averaged over both sides. A
    request that is not ``ok`` on its own side has no probability."""
    side = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    status = side(1, "status")
    prob = (side(1, "prob") + 1 - side(2, "prob")) / 2
    return scored.groupBy("request_id").agg(F.when(status == OK, prob).alias("prob_one"), status.alias("status"))


def fresh(history: DataFrame, requests: DataFrame, model: Model) -> DataFrame:
    return both_ways(model.score(model.scaled(request_values(history, both_sides(requests), model))))


def frozen(samples: DataFrame, requests: DataFrame, model: Model) -> DataFrame:
    """The same from the newest stored row of the pair, seen from both players.

    ``samples`` has scaled rows of both players of stored matches; ``swapped`` says the pair is
    asked against the order it is stored in.
    """
    pair = [F.least("player", "opponent").alias("a"), F.greatest("player", "opponent").alias("b")]
    asked = requests.select("request_id", *pair, (F.col("player") > F.col("opponent")).alias("swapped"))
    met = among(samples.withColumns(dict(zip("ab", pair))), cut_lineage(asked.select("a", "b").distinct()), ["a", "b"], "left_semi")
    one = model.score(met).select("a", "b", "tourney_date", "match_num", (F.col("player") < F.col("opponent")).alias("first"), "prob")
    meeting = one.groupBy("a", "b", "tourney_date", "match_num").agg(
        F.max(F.when(F.col("first"), F.col("prob"))).alias("p"), F.max(F.when(~F.col("first"), F.col("prob"))).alias("q")).where("p IS NOT NULL AND q IS NOT NULL")
    newest = meeting.groupBy("a", "b").agg(F.max_by(F.struct("p", "q", "match_num"), F.struct("tourney_date", "match_num")).alias("s"))
    prob = (F.col("s.p") + 1 - F.col("s.q")) / 2
    return asked.join(newest, ["a", "b"], "left").select(
        "request_id", F.when(F.col("swapped"), 1 - prob).otherwise(prob).alias("prob_one"), "swapped", F.col("s.match_num").alias("sample"))
