"""Stored discriminant and scored requests on small tables with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlens.plans import asked, discriminant, features, scoring, styles
from courtlens.sources.tables import shared_folder

HISTORY = ["player string", "opponent string", "match_id string", "match_num long", "tourney_date int", "label int", "surface string"]
VALUES = list(dict.fromkeys([*features.ROLLED, *scoring.STYLE_INPUT, *features.SEQUENCE_FEATURES, "serve_vs_return_edge", "return_vs_serve_edge", "net_edge"]))


def history(spark, n=400, players=6, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.sample([f"p{k}" for k in range(players)], 2)
        day, win = 20200101 + i // 15, rng.random() < 0.5
        for player, other, label in ((a, b, int(win)), (b, a, int(not win))):
            rows.append((player, other, f"m{i}", i, day, label, rng.choice(["Hard", "Clay", None]), *[rng.choice([None, rng.random() + 0.2 * label]) for _ in VALUES]))
    return spark.createDataFrame(rows, ", ".join([*HISTORY, *[f"{v} double" for v in VALUES]]))


@pytest.fixture(scope="module")
def fitted(spark):
    table = history(spark).cache()
    split = F.when(F.col("tourney_date") < 20200120, "train").otherwise("test")
    return table, discriminant.fit(table, split)


def test_weights_equal_plain_moments(fitted):
    _, fit = fitted
    rows = fit.scaled.where("split = 'train'").toPandas()
    assert len(rows)
    for i, name in enumerate(discriminant.NAMES):
        won, lost = (rows.loc[rows["label"] == y, name].to_numpy() for y in (1, 0))
        inside = (len(won) * won.var() + len(lost) * lost.var()) / len(rows)
        assert fit.model.weights[name] == pytest.approx((won.mean() - lost.mean()) / (inside + discriminant.SHRINKAGE), abs=1e-9)
    probs = fit.model.score(fit.scaled).toPandas()
    logit = probs[list(discriminant.NAMES)].to_numpy() @ np.array([fit.model.weights[n] for n in discriminant.NAMES]) + fit.model.intercept
    assert np.allclose(probs["prob"], 1 / (1 + np.exp(-logit)))


def test_styles_equal_plain_rounds(fitted):
    table, fit = fitted
    raw = table.where("tourney_date < 20200120").toPandas()[list(scoring.STYLE_INPUT)].fillna(0.0).to_numpy()
    z = (raw - raw.mean(0)) / raw.std(0)
    at = [scoring.STYLE_INPUT.index(c) for c in styles.START]
    group = (z[:, at[0]] >= 0) * 2 + (z[:, at[1]] >= 0)
    centres = np.array([z[group == k].mean(0) for k in range(4)])
    for _ in range(styles.ROUNDS):
        group = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([z[group == k].mean(0) if (group == k).any() else centres[k] for k in range(4)])
    strong = [scoring.STYLE_INPUT.index(c) for c in styles.STRENGTH]
    order = sorted(range(4), key=lambda k: centres[k][strong].sum())
    assert np.allclose(centres[order], fit.model.styles.centres)


def test_stored_model_is_read_back_and_checked(spark, fitted):
    _, fit = fitted
    place = shared_folder(spark, "model")
    discriminant.write_model(spark, fit.model, place)
    assert discriminant.read_model(spark, place) == fit.model
    broken = shared_folder(spark, "model")
    spark.read.parquet(place).where("part <> 'static_std'").write.parquet(broken)
    with pytest.raises(ValueError, match="static_std"):
        discriminant.read_model(spark, broken)


def test_request_values_equal_a_replay(spark, fitted):
    table, fit = fitted
    rows = [(1, "p0", "p1", 20200120, "Clay"), (2, "p1", "p0", 20200120, None), (3, "p2", "p3", 20190101, "Hard"),
            (4, "nobody", "p1", 20200120, "Hard"), (5, "p4", "nobody", 20200102, "Grass"), (6, "p5", "p4", 20200102, "Hard")]
    requests = spark.createDataFrame(rows, "request_id long, player string, opponent string, tourney_date int, surface string")
    out = {(r.request_id, r.side): r.asDict() for r in asked.request_values(table, asked.both_sides(requests), fit.model).collect()}
    assert len(out) == 12
    all_rows = table.toPandas().sort_values(["tourney_date", "match_num"])
    styled = {(r.player, r.match_num): r.player_style_cluster for r in fit.model.styles.add(table).collect()}
    known = set(all_rows["player"])
    for number, a, b, day, surface in rows:
        for side, (player, other) in ((1, (a, b)), (2, (b, a))):
            got = out[number, side]
            mine = all_rows[(all_rows["player"] == player) & (all_rows["tourney_date"] < day)]
            theirs = all_rows[(all_rows["player"] == other) & (all_rows["tourney_date"] < day)]
            status = asked.UNKNOWN if not {player, other} <= known else asked.OK if len(mine) else asked.NO_HISTORY
            assert (got["status"], got["steps"]) == (status, min(10, len(mine)))
            for f in features.SEQUENCE_FEATURES:
                assert got["mean_" + f] == pytest.approx(mine.tail(10)[f].fillna(0.0).mean() if len(mine) else 0.0)
            ten = mine.tail(10)[list(features.ROLLED)].mean()
            serve = 0.4 * ten["player_1st_win_pct"] + 0.4 * ten["player_2nd_win_pct"] + 0.1 * ten["player_ace_rate"] - 0.1 * ten["player_df_rate"] if len(mine) else 0.0
            last = theirs.iloc[-1] if len(theirs) else None
            taken = 0.0 if last is None or math.isnan(last["return_skill"]) else last["return_skill"]
            if not math.isnan(serve):
                assert got["serve_vs_return_edge"] == pytest.approx(serve - taken)
            assert got["opp_style_cluster"] == (0 if last is None else styled[other, last["match_num"]])
            assert got["style_matchup"] == got["player_style_cluster"] * 10 + got["opp_style_cluster"]
            assert got["surface_Clay"] == float(surface == "Clay") and got["surface_Hard"] == float((surface or "Hard") == "Hard")
    scores = {r.request_id: r for r in asked.fresh(table, requests, fit.model).collect()}
    assert scores[1].prob_one == pytest.approx(1 - scores[2].prob_one, abs=0.2) and scores[4].prob_one is None and scores[3].prob_one is None


def test_frozen_sample_of_a_pair(spark, fitted):
    table, fit = fitted
    rows = [(1, "p0", "p1", 20200301, "Clay"), (2, "p1", "p0", 20200301, "Clay"), (3, "p0", "nobody", 20200301, None)]
    requests = spark.createDataFrame(rows, "request_id long, player string, opponent string, tourney_date int, surface string")
    out = {r.request_id: r for r in asked.frozen(fit.scaled, requests, fit.model).collect()}
    assert (out[1].swapped, out[2].swapped) == (False, True) and out[1].prob_one == pytest.approx(1 - out[2].prob_one)
    assert out[3].prob_one is None
    meetings = [r.match_num for r in table.where("player = 'p0' AND opponent = 'p1'").collect()]
    assert out[1].sample == max(meetings)


def test_empty_history(spark, fitted):
    table, fit = fitted
    none = discriminant.fit(table.limit(0), F.lit("train"))
    assert none.model.styles.centres == () and set(none.model.weights.values()) == {0.0} and none.scaled.count() == 0
    requests = spark.createDataFrame([(1, "p0", "p1", 20200301, "Clay")], "request_id long, player string, opponent string, tourney_date int, surface string")
    assert [r.status for r in asked.fresh(table.limit(0), requests, fit.model).collect()] == [asked.UNKNOWN]


def test_fit_from_own_rows_equals_fit_from_the_feature_table(spark, fitted):
    """Styles fitted first, features added after the rows are dealt, and no mean squares among the stored rows."""
    table, fit = fitted
    split = F.when(F.col("tourney_date") < 20200120, "train").otherwise("test")
    looks = styles.fit(table.where(split == "train"), stage=lambda d: d)
    faced = discriminant.asof_join(looks.add(table), looks.add(table), left_key="opponent", right_key="player", day="tourney_date",
                                   number="match_num", values=["player_style_cluster"], prefix="opp_")
    kept = []

    def stage(df):
        kept.append(df.columns)
        return df.localCheckpoint()

    other = discriminant.fit(faced, split, fitted=looks, derive=lambda d: d, stage=stage)
    assert not [c for c in kept[0] if "square" in c]
    assert np.allclose([other.model.weights[n] for n in discriminant.NAMES], [fit.model.weights[n] for n in discriminant.NAMES])
    assert other.model.intercept == pytest.approx(fit.model.intercept)


def test_only_rows_near_a_request_are_read_with_their_values(spark, fitted, monkeypatch):
    table, model = history(spark), fitted[1].model
    sent, among = [], asked.among
    monkeypatch.setattr(asked, "among", lambda *a: sent.append(among(*a)) or sent[-1])
    rows = spark.createDataFrame([(1, "p0", "p1", 20200120, "Hard"), (2, "p2", "p3", 20200110, None), (3, "p4", "nobody", 20200103, "Clay")],
                                 "request_id int, player string, opponent string, tourney_date int, surface string")
    sides = asked.both_sides(rows)
    both = {(r.request_id, r.side): tuple(r) for r in asked.request_values(table, sides, model).collect()}
    read = sent[0].select("player", "tourney_date").collect()
    days = {(r.player, r.tourney_date) for r in read}
    assert len(read) < 300 < table.count() and {p for p, _ in days} == {"p0", "p1", "p2", "p3", "p4"}
    one = asked.request_values(table, sides.where("side = 1"), model).collect()
    assert all(tuple(r) == both[r.request_id, 1] for r in one) and len(one) == 3 and both[3, 1][-1] == asked.UNKNOWN
