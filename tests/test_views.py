from courtlens.operators import views


def test_spellings_of_one_slug_are_one_player(spark):
    rows = [("José Núñez", "ESP", "R", 180.0, 12.0, 20200101, 1), ("Jose Nunez", "ESP", "R", 180.0, 9.0, 20210101, 2),
            ("JOSE  NUNEZ", "ESP", "R", 180.0, 30.0, 20190101, 3), ("Ann Lee", None, "L", None, None, 20200101, 4)]
    df = spark.createDataFrame(rows, "player string, player_ioc string, player_hand string, player_ht double, player_rank double, tourney_date int, match_num long")
    out = {r.slug: r for r in views.latest_player_records(df).collect()}
    assert set(out) == {"jose-nunez", "ann-lee"}
    assert out["jose-nunez"].name == "Jose Nunez" and out["jose-nunez"].last_rank == 9 and out["ann-lee"].last_rank is None


def test_pair_known_only_in_reverse(spark):
    df = spark.createDataFrame([("A B", "C D", "m1", 20200101, 1), ("A B", "C D", "m2", 20210101, 2), ("C D", "E F", "m3", 20200101, 3)],
                               "player string, opponent string, match_id string, tourney_date int, match_num long")
    asked = spark.createDataFrame([(" c d", "A B"), ("a b", "C D "), ("E F", "A B"), ("C D", "E F")], "player_one string, player_two string")
    out = {(r.player_one, r.player_two): (r.swapped, r.match_id) for r in views.latest_sample_by_name(df, asked).collect()}
    assert out == {(" c d", "A B"): (True, "m2"), ("a b", "C D "): (False, "m2"), ("C D", "E F"): (False, "m3")}
