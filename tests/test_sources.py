import json
import os

import pytest

from courtlens import session
from courtlens.functions import dates
from courtlens.operators import ledger, orient
from courtlens.queries import all_queries  # noqa: F401  (registers all building blocks in order)
from courtlens.queries import ledger as ledger_queries, scoring as scoring_queries, serving, stored_model
from courtlens.sources import documents, tables
from pyspark.sql import functions as F


def test_raw_files_with_differing_headers(spark, tmp_path):
    (tmp_path / "older_years").mkdir()
    (tmp_path / "atp_matches_2020.csv").write_text("tourney_date,winner_name,loser_name,w_ace\n20200101,A,B,3\n20200102,C,D,\n")
    (tmp_path / "older_years" / "atp_matches_1990.csv").write_text("winner_name,loser_name,tourney_date,score\nE,F,19900101,6-4 6-4\n")
    df = tables.read_raw_matches(spark, str(tmp_path))
    got = {r.winner_name: r for r in df.collect()}
    assert got["A"].tourney_date == 20200101 and got["A"].w_ace == 3.0 and got["C"].w_ace is None
    assert got["E"].tourney_date == 19900101 and got["E"].score == "6-4 6-4" and got["E"].w_ace is None


def test_merged_file_is_the_fallback(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_raw_matches(spark, str(tmp_path))
    (tmp_path / "merged.csv").write_text("tourney_date,winner_name,loser_name\n20200101,A,B\n")
    assert tables.read_raw_matches(spark, str(tmp_path), str(tmp_path / "merged.csv")).count() == 1


def test_metric_documents(spark, tmp_path):
    doc = {"summary": {"val_accuracy_mean": 0.6}, "folds": [
        {"split": {"name": "f1", "description": "d", "val_cutoff": "20231231"}, "metrics": {"validation": {"accuracy": 0.6, "match_accuracy": 0.7, "auc": 0.75}}},
        {"split": {"name": "f2", "description": "d"}, "metrics": {"validation": {"accuracy": 0.65}}}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    rows = {r.name: r for r in documents.fold_rows(documents.read_metric_documents(spark, str(tmp_path / "m.json"))).collect()}
    assert rows["f1"].accuracy == 0.7 and rows["f1"].season == "2023"
    assert rows["f2"].accuracy == 0.65 and rows["f2"].season == "f2" and rows["f2"].auc is None


def test_calibration_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"method": "temperature", "temperature": 0.72}))
    (tmp_path / "bad.json").write_text(json.dumps({"temperature": 0.72}))
    assert tables.read_calibration(spark, str(tmp_path / "c.json")) == {"method": "temperature", "temperature": 0.72}
    assert tables.read_calibration(spark, str(tmp_path / "bad.json")) is None
    assert tables.read_calibration(spark, str(tmp_path / "none.json")) is None


def test_predictions_without_files(spark, tmp_path):
    assert tables.read_predictions(spark, str(tmp_path), 2024) is None


def test_written_table_is_partitioned_by_year(spark, tmp_path):
    df = spark.createDataFrame([(20200101, "A"), (20210101, "B")], "tourney_date int, winner_name string")
    tables.write_table(df, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"year=2020", "year=2021"}
    assert tables.read_table(spark, str(tmp_path / "t"), ["winner_name"]).count() == 2


def test_dates_in_any_form(spark):
    df = spark.createDataFrame([("2024-01-15",), ("20240115",), ("junk",), (None,)], "d string")
    got = [r.v for r in df.select(dates.as_int_day(F.col("d"), df.schema["d"].dataType).alias("v")).collect()]
    assert got == [20240115, 20240115, 0, 0]


def test_two_sided_mirrors(spark):
    df = spark.createDataFrame([(20200101, 1, "A", "B", 5.0, 9.0, 3, 4, "500")],
                               "tourney_date int, match_num long, winner_name string, loser_name string, winner_rank double, loser_rank double, w_ace int, l_ace int, tourney_level string")
    w, l = orient.two_sided(df).orderBy(F.col("label").desc()).collect()
    assert (w.player, w.opponent, w.ace, w.opponent_ace, w.player_rank) == ("A", "B", 3, 4, 5.0)
    assert (l.player, l.opponent, l.ace, l.opponent_ace, l.player_rank) == ("B", "A", 4, 3, 9.0)
    assert w.match_id == l.match_id == "A_B_20200101" and w.tourney_level == "A"
    with pytest.raises(ValueError, match="loser_name"):
        orient.two_sided(df.drop("loser_name"))


def test_first_lines_in_one_job(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"atp matches_{i}.csv").write_text(("a,b,c" if i % 2 else "c,\"x,y\"") + "\n" + f"{i},2,3\n" * i)
    (tmp_path / "atp matches_empty.csv").write_text("")
    spark.sparkContext.setJobGroup("first lines", "first lines")
    rows = tables.first_lines(spark, [str(tmp_path / "*.csv")]).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("first lines")
    spark.sparkContext.setJobGroup("", "")
    assert len(rows) == 40 and {r.line for r in rows} == {"a,b,c", "c,\"x,y\""} and len(jobs) <= 3


def test_cache_keeps_the_old_version_until_the_new_one_is_whole(spark, tmp_path):
    place, old = str(tmp_path / "cache"), spark.createDataFrame([(1, 2.0)], "n int, a double")
    assert tables.load_or_build_features(spark, place, ["a"], lambda: old).columns == ["n", "a"]

    def fails():
        return spark.range(4).select(F.raise_error(F.lit("stopped half way")).cast("string").alias("b"))

    with pytest.raises(Exception, match="half way"):
        tables.load_or_build_features(spark, place, ["b"], fails)
    kept = tables.load_or_build_features(spark, place, ["a"], lambda: pytest.fail("not read from the cache"))
    assert [tuple(r) for r in kept.collect()] == [(1, 2.0)]
    new = spark.createDataFrame([(5, 6.0)], "n int, a double")
    forced = tables.load_or_build_features(spark, place, ["a"], lambda: new, force=True)
    assert [tuple(r) for r in forced.collect()] == [(5, 6.0)] and [tuple(r) for r in kept.collect()] == [(1, 2.0)]


def test_documents_of_unlike_runs(spark, tmp_path):
    for name, doc in {"a": {"run": "a", "metrics": {"test": {"accuracy": 0.6, "match_accuracy": 0.7, "match_auc": 0.8}}},
                      "b": {"run": "b", "metrics": {"test": {"accuracy": 0.5, "brier": 0.2}, "other": [1]}}, "c": {"run": "c"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    rows = {r.run: r for r in documents.test_metrics(documents.read_run_documents(spark, str(tmp_path))).collect()}
    assert (rows["a"].accuracy, rows["a"].auc, rows["a"].brier) == (0.7, 0.8, 0.0)
    assert (rows["b"].accuracy, rows["b"].auc, rows["b"].brier) == (0.5, 0.0, 0.2)
    assert tuple(rows["c"])[1:] == (0.0, 0.0, 0.0, 0.0)


def test_column_contract(spark):
    df = spark.createDataFrame([("x", 1), (None, 2)], "a string, b int")
    rows = {r.column: r for r in orient.column_contract(df, {"a": "string", "b": "double", "c": "int"}).collect()}
    assert (rows["a"].present, rows["a"].fits, rows["a"].filled) == (True, True, 1)
    assert (rows["b"].found, rows["b"].fits, rows["b"].filled) == ("int", False, 2)
    assert (rows["c"].present, rows["c"].found, rows["c"].fits, rows["c"].filled) == (False, None, False, 0)


def _cut(spark):
    return {f for f in os.listdir(os.path.dirname(tables.shared_folder(spark, "none")).removeprefix("file:")) if f.startswith("cut-")}


def test_tables_on_the_way_go_and_shuffle_files_too(spark, monkeypatch):
    already, seen, before = _cut(spark), [], spark.conf.get(session.TIDY)
    rows = spark.range(10)

    def build():
        first = session.cut_lineage(rows.selectExpr("id", "id % 3 AS k"))
        seen.append(spark.conf.get(session.TIDY))
        return first.groupBy("k").count()

    with session.passing(spark):
        kept = session.cut_from(spark, build)
        assert len(_cut(spark) - already) == 1 and sorted(r["count"] for r in kept.collect()) == [3, 3, 4]
    assert _cut(spark) == already and spark.conf.get(session.TIDY) == before == seen[0]
    with pytest.raises(ValueError):
        session.cut_from(spark, lambda: int("x"))
    assert not session._open


def test_reports_leave_no_tables_behind(spark, folder):
    already = _cut(spark)
    place = serving._reports(spark, folder).removeprefix("file:")
    assert _cut(spark) == already and any(f.endswith(".json.gz") for f in os.listdir(f"{place}/equity"))
    assert tables.read_equity(spark, place).count() == ledger.equity_curve(ledger_queries.path(spark, folder), ledger_queries.PATH).count()


def test_the_unscaled_feature_rows_are_all_that_stays(spark, folder):
    already = _cut(spark)
    scoring_queries.feature_table(spark, folder)
    assert len(_cut(spark) - already) == 1


def test_stored_model_keeps_only_its_tables(spark, folder):
    stored_model._STORED.pop((spark.sparkContext.applicationId, folder), None)
    already = _cut(spark)
    stored_model.stored(spark, folder)
    assert _cut(spark) == already
