import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from courtlens.operators import sequences, timeline, windows
from courtlens.operators.asof import asof_join
from courtlens.plans import features, legacy, serve
from courtlens.queries.base import player_table
from courtlens.session import cut_lineage


def make_rows(n=400, seed=3, hot=0.7):
    """Matches of few players, one of whom owns most rows and many share a date."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        player = "hot" if rnd.random() < hot else f"p{rnd.randrange(4)}"
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(40))
        rows.append((player, f"o{rnd.randrange(3)}", int(day.strftime("%Y%m%d")), i, rnd.randrange(2), rnd.random()))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(make_rows(), "player string, opponent string, tourney_date int, match_num long, label int, v double")


@pytest.mark.parametrize("limit", [1, 7, 40, 150])
def test_long_key_windows_equal_plain_windows(rows, limit):
    def build(w):
        return {"m": F.round(F.avg("v").over(w.rowsBetween(-12, -1)), 9), "lag": F.lag("match_num").over(w),
                "h": F.size(F.collect_list("v").over(w.rowsBetween(-12, -1)))}

    plain = timeline.history_columns(rows, ["player"], "tourney_date", ["tourney_date", "match_num"], 12, build)
    cut = timeline.history_columns(rows, ["player"], "tourney_date", ["tourney_date", "match_num"], 12, build, rows_per_run=limit)
    columns = ("player", "match_num", "m", "lag", "h")
    assert cut.columns == plain.columns
    a = sorted(map(str, plain.select(*columns).collect()))
    b = sorted(map(str, cut.select(*columns).collect()))
    assert a == b


def test_global_position_is_a_total_order(rows):
    placed = timeline.global_position(rows, [F.col("v"), F.col("match_num")], "pos")
    got = [r.match_num for r in placed.orderBy("pos").select("match_num").collect()]
    want = [r.match_num for r in rows.orderBy("v", "match_num").select("match_num").collect()]
    assert got == want
    assert [r.pos for r in placed.orderBy("pos").collect()] == list(range(1, len(want) + 1))


@pytest.fixture
def small_ranges_kept_apart(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_ranges_stay_even_when_one_value_is_nine_tenths(spark, small_ranges_kept_apart):
    rnd = random.Random(6)
    data = [(0.35 if rnd.random() < 0.9 else rnd.random(), 20200101 + rnd.randrange(28), i) for i in range(8000)]
    rows = spark.createDataFrame(data, "v double, day int, n long").repartition(5)
    order = [F.col("v"), F.col("day"), F.col("n")]
    sizes = [r["count"] for r in timeline.in_ranges(rows, order).groupBy("_range").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 8000 * 0.5
    placed = {r.n: r.pos for r in timeline.global_position(rows, order, "pos").collect()}
    assert [placed[n] for _, _, n in sorted(data)] == list(range(1, 8001))


@pytest.mark.parametrize("mode", ["upto", "before", "day"])
def test_asof_join_against_brute_force(spark, rows, mode):
    data = make_rows()
    left = spark.createDataFrame([(f"q{i}", random.Random(i).choice(["hot", "p0", "p1", "none"]), d, n)
                                  for i, (_, _, d, n, _, _) in enumerate(data[::3])], "q string, who string, tourney_date int, match_num long")
    out = asof_join(left, rows, left_key="who", right_key="player", day="tourney_date", number="match_num", values=["v"], mode=mode)
    for r in out.collect():
        fits = [(d, n, v) for p, _, d, n, _, v in data if p == r.who and (
            (d, n) <= (r.tourney_date, r.match_num) if mode == "upto" else d < r.tourney_date if mode == "before" else d <= r.tourney_date)]
        assert r.asof_v == (max(fits)[2] if fits else None)


def test_streaks_against_brute_force(rows):
    got = {r.match_num: (r.prior_streak, r.streak_after) for r in windows.streaks(rows).collect()}
    by_player = {}
    for p, _, d, n, label, _ in sorted(make_rows(), key=lambda r: (r[0], r[2], r[3])):
        prior = by_player.get(p, 0)
        after = (prior + 1 if prior >= 0 else 1) if label else (prior - 1 if prior <= 0 else -1)
        assert got[n] == (prior, after)
        by_player[p] = after


def test_stored_streak_against_literal_rule(rows):
    got = {r.match_num: r.stored_streak for r in windows.first_run_streak(rows).collect()}
    data = make_rows()
    for p, _, d, n, _, _ in data[::5]:
        prior = [r[4] for r in sorted(data, key=lambda r: (r[2], r[3])) if r[0] == p and r[2] < d]
        s = 0
        for label in reversed(prior):
            s = (s + 1 if s >= 0 else 1) if label == 1 else (s - 1 if s <= 0 else -1)
        assert got[n] == s


def test_strict_history_is_strictly_earlier_and_complete(rows):
    data = make_rows()
    for r in sequences.strict_history(rows, ["v"]).collect():
        want = [x[5] for x in sorted((x for x in data if x[0] == r.player and x[2] < r.tourney_date), key=lambda x: (x[2], x[3]))][-10:]
        assert [h.v for h in r.history] == want


def test_past_only_features_do_not_change_when_the_future_is_cut(spark, folder):
    df = player_table(spark, folder)
    cut = 19990101
    cols = ["player", "match_num", "serve_skill", "return_skill", "opp_serve_skill", "spw_diff", "days_since_last_match"]
    full = features.match_features(df).filter(F.col("tourney_date") < cut).select(*cols)
    short = features.match_features(df.filter(F.col("tourney_date") < cut)).select(*cols)
    assert full.exceptAll(short).count() == 0 and short.exceptAll(full).count() == 0


def test_row_sequences_drop_short_histories(spark, folder):
    df = features.match_features(player_table(spark, folder))
    seq = sequences.row_sequences(df, features.SEQUENCE_FEATURES)
    players = df.select("player").distinct().count()
    assert seq.count() == df.count() - 10 * players
    r = seq.first()
    assert len(r.sequence) == 10 and r.mask == [1.0] * 10 and list(r.sequence[0].asDict()) == list(features.SEQUENCE_FEATURES)


def timeline_rows():
    """Ten matches of A, seven of B, the target match and two later ones."""
    rows = []

    def add(player, opponent, day, num, label, won):
        rows.append((player, opponent, f"m{num}", day, num, label, won, 20, 80, won - 5, 18, 82, 30.0, 40.0, "Hard", "M", "F"))

    for i in range(10):
        add("A", f"x{i}", 20250101 + i * 2, i, i % 2, 30 + i)
    for i in range(7):
        add("B", f"y{i}", 20250102 + i * 3, 100 + i, 1, 35)
    add("A", "B", 20250315, 200, 1, 40)
    add("B", "A", 20250315, 200, 0, 33)
    add("A", "z", 20250320, 201, 1, 50)
    return rows


def test_leakage_timeline(spark):
    df = spark.createDataFrame(timeline_rows(), (
        "player string, opponent string, match_id string, tourney_date int, match_num long, label int, player_1stWon int, player_2ndWon int, "
        "player_svpt int, opp_1stWon int, opp_2ndWon int, opp_svpt int, player_rank double, opponent_rank double, surface string, tourney_level string, round string"))
    built = legacy.with_sequences(legacy.with_step_inputs(df))
    assert sequences.past_only_violations(built, "history", "sequence", "mask").count() == 0
    target = built.filter("player = 'A' and match_num = 200").first()
    assert [h["_day"] for h in target.history] == [20250101 + i * 2 for i in range(10)]
    assert sum(target.mask) == 10
    b = built.filter("player = 'B' and match_num = 200").first()
    assert b.mask == [0.0] * 3 + [1.0] * 7
    assert all(v == 0.0 for s in b.sequence[:3] for v in s)
    first = built.filter("player = 'A' and match_num = 0").first()
    assert sum(first.mask) == 0 and all(v == 0.0 for s in first.sequence for v in s)
    for step in target.sequence:
        assert step.form_delta_serve == pytest.approx(step.adj_serve_short_decay - step.adj_serve_medium_decay)
    serve = [h.adj_serve for h in target.history]
    assert target.sequence[0].adj_serve_short_decay == pytest.approx(serve[0])
    assert target.sequence[2].adj_serve_short_decay == pytest.approx((0.10 * serve[0] + 0.25 * serve[1]) / 0.35)
    assert target.sequence[5].adj_serve_short_decay == pytest.approx(0.10 * serve[2] + 0.25 * serve[3] + 0.65 * serve[4])


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="opponent_rank"):
        legacy.with_step_inputs(spark.createDataFrame([("a", 1)], "player string, tourney_date int"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_rows_are_compressed_and_read_by_column(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS kind", "IF(id % 3 = 0, NULL, id / 2) AS half", "array(id, id + 1) AS pair")
    cut = cut_lineage(df)
    assert cut.dtypes == df.dtypes and sorted(map(tuple, cut.select("id", "half").collect()), key=lambda r: r[0]) == sorted(
        map(tuple, df.select("id", "half").collect()), key=lambda r: r[0])
    assert "ReadSchema: struct<kind:bigint>" in _plan(cut.select("kind"))


def test_state_of_days_is_not_sent_whole_to_everyone(spark):
    rows = [("a", 20200101 + k, k, float(k)) for k in range(20)]
    df = cut_lineage(spark.createDataFrame(rows, "player string, tourney_date int, match_num long, v double"))
    asof = asof_join(df, df, left_key="player", right_key="player", day="tourney_date", number="match_num", values=["v"], mode="before")
    for out in (sequences.strict_history(df, ["v"]), asof):
        assert "Broadcast" not in _plan(out) and out.count() == 20


def test_only_rows_before_a_request_keep_their_lists(spark):
    rows = [(p, d, n) for p, days in (("a", (1, 2, 2, 5, None)), ("b", (3, 4))) for n, d in enumerate(days)]
    history = spark.createDataFrame(rows, "player string, tourney_date int, match_num long")
    asked = spark.createDataFrame([("a", 2, 90), ("a", 5, 91), ("a", 5, 91), ("b", 3, 92), ("c", 9, 93), (None, 9, 94)], history.schema)
    got = serve._marked(history, asked).where("_asked").select("player", "tourney_date", "match_num").collect()
    assert sorted(map(tuple, got)) == [("a", 1, 0), ("a", 2, 1), ("a", 2, 2)]
    early = spark.createDataFrame([("a", 1, 95)], history.schema)  # rows without a date come before every date
    assert [tuple(r) for r in serve._marked(history, early).where("_asked").collect()] == [("a", None, 4, True)]


@pytest.mark.parametrize("limit", [None, 7])
def test_long_means_from_sums_of_earlier_rows_equal_plain_frames(spark, limit):
    rows = [(f"p{i % 2}", 20200101 + i // 3, i, *[(i * k % 17) / 17 for k in range(1, 7)]) for i in range(120)]
    df = spark.createDataFrame(rows, "player string, tourney_date int, match_num long, " + ", ".join(f"{r} double" for r in features.ROLLED))

    def known(d):  # rates that are never missing, as the plan's are
        return d.withColumns({r: F.coalesce(r, F.lit(0.0)) for r in features.ROLLED})

    found = features.with_rolling(df, rows_per_run=limit, derive=known).toPandas().sort_values(["player", "match_num"])
    plain = features.with_rolling(df, rows_per_run=limit).toPandas().sort_values(["player", "match_num"])
    assert list(found.columns) == list(plain.columns)
    for c in [f"{r}_roll{n}" for r in features.ROLLED for n in features.WINDOWS]:
        want = [None if not k else sum(v[max(0, k - int(c.rsplit("roll")[1])):k]) / min(k, int(c.rsplit("roll")[1]))
                for _, v in ((p, g[c.rsplit("_roll")[0]].tolist()) for p, g in plain.groupby("player")) for k in range(len(v))]
        for got in (found, plain):
            assert [None if x != x else round(x, 9) for x in got[c]] == [None if x is None else round(x, 9) for x in want]


def test_row_sequences_add_fields_after_rows_are_dealt(spark):
    rows = [("p", 20200101 + i, i, float(i)) for i in range(15)]
    df = spark.createDataFrame(rows, "player string, tourney_date int, match_num long, v double")
    out = sequences.row_sequences(df, ["x"], 3, derive=lambda d: d.withColumn("x", F.col("v") * 2)).orderBy("match_num").collect()
    assert [[s.x for s in r.sequence] for r in out] == [[2.0 * (i - 3), 2.0 * (i - 2), 2.0 * (i - 1)] for i in range(3, 15)]
