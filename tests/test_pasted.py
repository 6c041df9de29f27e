import datetime as dt

import pytest
from pyspark.sql import functions as F

from courtlens.operators import pasted

LINE = "19-Jan-2026\tAustralian Open\tHard\tR128\t6\t29\t(6)De Minaur d. (29)Frances Tiafoe [USA]\t6-4 7-6(5) 6-3\t1.25\t8.2%\t6.2%\t61.9%\t78.3%\t51.4%\t3/5\t2:43"
LOST = "12-Jan-2026\tSydney\tHard\tSF\t6\t17\t(17)Casper Ruud [NOR] d. (6)De Minaur\t7-5 6-4\t0.95\t5.0%\t2.0%\t60.0%\t70.0%\t50.0%\t1/4\t1:50"
NEXT = "20-Jan-2026\tAustralian Open\tHard\tR64\t6\t10\t(6)De Minaur vs (10)Alexander Bublik [KAZ]\t\t\t"
RETIRED = "05-Jan-2026\tBrisbane\tHard\tR32\t6\t\t(6)De Minaur d. Some One\t6-4 2-1 RET\t1.0\t5%\t2%\t60%\t70%\t50%\t1/4\t1:00"
HEADER = "Date\tTournament\tSurface\tRd\tRk\tvRk\t\tScore\tDR\tA%\tDF%\t1stIn\t1st%\t2nd%\tBPSvd\tTime"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [
        (1, "Alex de Minaur", "\n".join([HEADER, LINE, LOST, "", NEXT, RETIRED])), (2, "alex-de-minaur", "\n".join([LINE, LOST])),
        (3, "x", ""), (4, "x", HEADER), (5, "x", "nothing here\nat all"), (6, "x", None), (7, "x", "a  b   c\n  \n d\te \t\t"),
        (8, "", "01/31/2025  Event  Clay  F  5  7  text"),
    ]
    return spark.createDataFrame(rows, "doc_id long, player_name string, text string")


def test_normalised_lines(texts):
    lines = {r.doc_id: r.l for r in texts.select("doc_id", pasted.normalised_lines(F.col("text")).alias("l")).collect()}
    assert lines[3] == [] and lines[6] == []
    assert lines[7] == ["a b c", "d\te"]
    assert len(lines[1]) == 5


def test_header_and_columns(texts):
    rows = pasted.read_lines(texts).filter("doc_id = 1").collect()
    assert len(rows) == 4 and all(r.has_header for r in rows)
    assert rows[0].column_map["rank"] == 4 and rows[0].column_map["opponent_rank"] == 5
    assert rows[0].column_map["match_description"] == 6 and rows[0].column_map["score"] == 7
    assert pasted.read_lines(texts).filter("doc_id = 4").count() == 0


def test_flags_and_display(texts):
    rows = {r.row_index: r for r in pasted.tuned(pasted.for_display(pasted.with_flags(pasted.read_lines(texts.filter("doc_id = 1"))))).collect()}
    assert not rows[1].is_ignored and rows[1].formatted_line.startswith("19-Jan-2026, Australian Open, Hard")
    assert rows[3].ignore_reasons == ["Upcoming match"]
    assert rows[4].ignore_reasons == ["Retirement", "Incomplete data", "Missing vRk"]
    summary = pasted.parse_summary(pasted.for_display(pasted.with_flags(pasted.read_lines(texts)))).filter("doc_id = 1").first()
    assert (summary.total_rows, summary.valid_matches, summary.ignored_rows, summary.has_header) == (4, 2, 2, True)


def test_typed_matches(texts):
    rows = {(r.doc_id, r.row_index): r for r in pasted.typed_matches(texts).collect()}
    won = rows[(1, 1)]
    assert (won.result, won.opponent, won.player_rank, won.opponent_rank) == ("W", "Frances Tiafoe", 6, 29)
    assert won.match_date == dt.date(2026, 1, 19) and won.score == "6-4 7-6(5) 6-3" and won.is_valid
    serve = 0.619 * 0.783 + (1 - 0.619) * 0.514
    assert won.return_pct == pytest.approx(1 - serve / 1.25)
    assert won.break_points_saved == pytest.approx(0.6)
    lost = rows[(1, 2)]
    assert (lost.result, lost.opponent) == ("L", "Casper Ruud")
    assert rows[(1, 3)].result == "" and not rows[(1, 3)].is_valid
    assert not rows[(1, 4)].is_valid
    assert rows[(2, 0)].result == "W" and rows[(2, 1)].result == "L"
    assert not any(r.is_valid for k, r in rows.items() if k[0] in (5, 8))


@pytest.mark.parametrize("text", ["19-Jan-2026", "19-January-2026", "2026-01-19", "01/19/2026", "19/01/2026", "2026/01/19", "01-19-2026", "19-01-2026"])
def test_dates(spark, text):
    assert spark.range(1).select(pasted.parsed_date(F.lit(text))).first()[0] == dt.date(2026, 1, 19)


def test_unreadable_date_is_null(spark):
    assert spark.range(1).select(pasted.parsed_date(F.lit("soon"))).first()[0] is None


def test_too_few_valid_matches_are_marked(texts):
    assert [r.enough for r in pasted.newest_valid(pasted.typed_matches(texts.filter("doc_id = 1")), 3).collect()] == [False, False]


def test_lines_are_cleaned_once_per_text(texts):
    maps = pasted.read_lines(texts).where("column_map IS NOT NULL").select("doc_id", "row_index", "column_map")
    plan = maps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4  # twelve when the lines and the labels of a header were worked out at every use
    assert {r.doc_id for r in maps.collect()} == {1}


def test_trimming_is_what_the_pattern_does(spark):
    odd = [None, "", " ", "\t a  b \x0b\f\r", "a \n", " a  ", "a \u0085", " ", " a  ", " \r", "a\r\n", "a   "]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    b = pasted.BLANK
    row = lambda *c: [tuple(r) for r in df.select(*c).collect()]
    t = F.col("t")
    assert row(pasted.stripped(t), pasted._right_stripped(t), pasted._left_stripped(t), pasted._single_spaced(t)) == row(
        F.regexp_replace(t, f"^{b}+|{b}+$", ""), F.regexp_replace(t, f"{b}+$", ""), F.regexp_replace(t, f"^{b}+", ""), F.regexp_replace(t, " +", " "))


def test_lines_are_read_once_for_the_newest(texts):
    plan = pasted.newest_valid(pasted.typed_matches(texts))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan
