"""Pasted match-history text as a batch job over a table ``(doc_id, text, player_name)``.

Everything about one text is worked out inside its row with array functions; lines are exploded
only at the end, so no step shuffles. Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtlens.session import cut_lineage

# Words that mark a header line, header patterns in the order they are tried.
HEADER_WORDS = ("date", "rank", "opponent", "tournament", "surface", "result", "w/l")
DISPLAY_PATTERNS = (
    ("date", "date|dt"), ("rank", "^rk$|rank|player.*rank"), ("opponent_rank", "v.*rk|opp.*rank|opponent.*rank"),
    ("tournament", "tournament|tourney|event"), ("surface", "surface|surf"), ("round", "round|rd"),
    ("result", "^w/l$|result|^res$"), ("score", "score"), ("first_in_pct", "1stin|1st.*in"),
    ("first_won_pct", "1st%|1stwon"), ("second_won_pct", "2nd%|2ndwon"),
)
TYPED_PATTERNS = (
    ("date", "date|dt"), ("rank", "^rk$|rank|player.*rank"), ("opponent_rank", "v.*rk|opp.*rank|opponent.*rank"),
    ("opponent", "opponent|opp|vs"), ("tournament", "tournament|tourney|event"), ("surface", "surface|surf"),
    ("round", "round|rd"), ("result", "^w/l$|result|^res$"), ("score", "score"), ("first_in_pct", "1stin|1st.*in"),
    ("first_won_pct", "1st%|1stwon"), ("second_won_pct", "2nd%|2ndwon"), ("aces", "^ace$|^a$"),
    ("df", "^df$|double.*fault"), ("bp_saved", "bpsv|bp.*sav"), ("bp_conv", "bpconv|bp.*con"),
)
MISSING_RANK = ("", "-", "—", "–", "na", "n/a", "nan", ".")
NULL_WORDS = ("", "-", "—", "–", "na", "n/a", "nan", ".", "..", "null")
DATE_FORMATS = ("d-MMM-yyyy", "d-MMMM-yyyy", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "M-d-yyyy", "d-M-yyyy")
BLANK = "[ \\t\\r\\f\\x0B]"
SET_SCORE = "([0-9]+-[0-9]+(?:\\([0-9]+\\))?(?:\\s+[0-9]+-[0-9]+(?:\\([0-9]+\\))?)+)"


_BLANKS = " \t\r\f\x0b"
#: Before one of these at the end, the pattern's ``$`` stands as well.
_ENDS = ("\n", "\u0085", "\u2028", "\u2029")


def _plain_end(text: Column) -> Column:
    ends = F.endswith(text, F.lit(_ENDS[0]))
    for end in _ENDS[1:]:
        ends = ends | F.endswith(text, F.lit(end))
    return ~ends


def stripped(text: Column) -> Column:
    """Without blanks at both ends; trimming is what the pattern does, at a part of its time."""
    return F.when(_plain_end(text), F.btrim(text, F.lit(_BLANKS))).otherwise(F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", ""))


def _right_stripped(text: Column) -> Column:
    return F.when(_plain_end(text), F.rtrim(text, F.lit(_BLANKS))).otherwise(F.regexp_replace(text, f"{BLANK}+$", ""))


def _left_stripped(text: Column) -> Column:
    return F.ltrim(text, F.lit(_BLANKS))


def _single_spaced(text: Column) -> Column:
    return F.when(text.contains("  "), F.regexp_replace(text, " +", " ")).otherwise(text)


def normalised_lines(text: Column) -> Column:
    """Lines without blank ones; tabs stay, spaces are collapsed inside the tab-separated parts."""
    def clean(line: Column) -> Column:
        parts = F.split(_right_stripped(line), "\t")
        return F.array_join(F.transform(parts, lambda p: _single_spaced(stripped(p))), "\t")

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: stripped(line) != "")
    return F.transform(lines, clean)


def _keyword_count(text: Column) -> Column:
    lower = F.lower(text)
    return sum((lower.contains(w).cast("int") for w in HEADER_WORDS), F.lit(0))


def header_index(lines: Column) -> Column:
    """Zero-based index of the first header-like line among the first five, -1 without one."""
    hits = F.transform(F.slice(lines, 1, 5), lambda line: _keyword_count(line) >= 3)
    return F.coalesce(F.array_position(hits, True), F.lit(0)).cast("int") - 1


def split_fields(line: Column) -> Column:
    """Tab, else runs of two or more blanks, else any blanks."""
    by_tab = F.split(line, "\t")
    wide = F.split(line, f"{BLANK}{{2,}}")
    narrow = F.split(line, f"{BLANK}+")
    chosen = F.when(line.contains("\t"), by_tab).when(F.size(wide) > 1, wide).otherwise(narrow)
    return F.transform(chosen, stripped)


def _header_labels(columns: Column, patterns) -> Column:
    def label(c: Column) -> Column:
        low = F.lower(stripped(c))
        value = F.lit(None).cast("string")
        for name, pattern in reversed(patterns):
            value = F.when(low.rlike(pattern), F.lit(name)).otherwise(value)
        return F.when(low == "", F.lit(None).cast("string")).otherwise(value)

    return F.transform(columns, label)


def _with_column_map(df: DataFrame, header: Column, patterns) -> DataFrame:
    """Adds ``column_map``: field name to column index, the later of two columns with one name wins.

    The unnamed column between opponent rank and score is the match description.
    """
    columns = F.when(header.contains("\t"), F.split(header, "\t")).otherwise(F.split(header, f"{BLANK}{{2,}}"))
    placed = _computed(df, {"_labels": _header_labels(columns, patterns)}).withColumn("_size", F.size("_labels"))

    def last_place(name: str) -> Column:
        back = F.array_position(F.reverse("_labels"), name)
        return F.when(back > 0, F.col("_size") - back).cast("int")

    placed = _computed(placed, {f"_at_{n}": last_place(n) for n, _ in patterns})
    opp, score = F.col("_at_opponent_rank"), F.col("_at_score")
    end = F.coalesce(score, opp + 2)
    free = F.filter(F.transform("_labels", lambda name, i: F.when(name.isNull() & (i > opp) & (i < end), i)), lambda i: i.isNotNull())
    pairs = [F.struct(F.lit(n).alias("key"), F.col(f"_at_{n}").alias("value")) for n, _ in patterns]
    pairs.append(F.struct(F.lit("match_description").alias("key"), F.get(free, F.lit(0)).alias("value")))
    known = F.filter(F.array(*pairs), lambda c: c.value.isNotNull())
    return placed.withColumn("column_map", F.when(header.isNotNull(), F.map_from_entries(known))).drop(
        "_labels", "_size", *[f"_at_{n}" for n, _ in patterns])


def read_lines(df: DataFrame, patterns=DISPLAY_PATTERNS) -> DataFrame:
    """One row per data line: index, line, fields and the column map of its text (null without header)."""
    prepared = _computed(_computed(df, {"_lines": normalised_lines(F.col("text"))}), {"_header": header_index(F.col("_lines"))})
    prepared = prepared.withColumn("_head", F.when(F.col("_header") >= 0, F.get(F.col("_lines"), F.col("_header"))))
    mapped = _with_column_map(prepared, F.col("_head"), patterns).drop("_head")
    lines = mapped.select(*[c for c in df.columns if c != "text"], "column_map", (F.col("_header") >= 0).alias("has_header"),
                          "_header", F.posexplode("_lines").alias("row_index", "line"))
    data = lines.filter(F.col("row_index") > F.col("_header")).drop("_header")
    return data.withColumn("fields", split_fields(F.col("line")))


def _map_at(name: str) -> Column:
    return F.coalesce(F.col("column_map")[name], F.lit(-1))


def with_flags(rows: DataFrame, literal: bool = True) -> DataFrame:
    """What kind of row it is, without dropping any.

    ``literal`` looks for walkover and retirement marks in the whole line, where names can
    trigger them; otherwise only the score field is looked at.
    """
    low = F.lower("line")
    score = F.lower(F.coalesce(F.get("fields", F.when(_map_at("score") >= 0, _map_at("score")).otherwise(F.lit(7))), F.lit("")))
    place = low if literal else score

    def any_of(*marks):
        return sum((place.contains(m).cast("int") for m in marks), F.lit(0)) > 0

    few = F.size("fields") < 3

    def missing(name):
        value = F.lower(F.get("fields", _map_at(name)))
        return (_map_at(name) >= 0) & (_map_at(name) < F.size("fields")) & value.isin(*MISSING_RANK)

    no_rank, no_opponent_rank = missing("rank"), missing("opponent_rank")
    rank_error = F.when(no_rank, "Missing Rk").when(no_opponent_rank, "Missing vRk")
    first_five = F.array_join(F.slice("fields", 1, 5), " ")
    return rows.withColumns({
        "is_upcoming": low.contains(" vs "),
        "is_walkover": any_of("w/o", "wo", "walkover"),
        "is_retirement": any_of("ret", "retirement", "retired"),
        "is_incomplete": few | F.coalesce(no_rank | no_opponent_rank, F.lit(False)),
        "parse_errors": F.array_compact(F.array(F.when(few, "Too few fields"), rank_error)),
        "is_header": _keyword_count(first_five) >= 2,
    })


def for_display(rows: DataFrame) -> DataFrame:
    """Data rows with the ignore decision and its reasons; header-like rows are left out."""
    reasons = F.concat(F.array_compact(F.array(
        F.when(F.col("is_walkover"), "Walkover"), F.when(F.col("is_retirement"), "Retirement"),
        F.when(F.col("is_upcoming"), "Upcoming match"), F.when(F.col("is_incomplete"), "Incomplete data"))), "parse_errors")
    return rows.filter(~F.col("is_header")).withColumn("ignore_reasons", reasons).withColumn(
        "is_ignored", F.size("ignore_reasons") > 0)


def tuned(rows: DataFrame) -> DataFrame:
    """Fields without trailing empty ones and a comma-separated line of the filled fields."""
    last = F.array_max(F.transform("fields", lambda f, i: F.when(f != "", i + 1).otherwise(F.lit(1))))
    short = F.slice("fields", F.lit(1), last)
    return rows.withColumn("fields", short).withColumn(
        "formatted_line", F.array_join(F.filter("fields", lambda f: f != ""), ", "))


def parse_summary(display: DataFrame) -> DataFrame:
    return display.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(~F.col("is_ignored")).alias("valid_matches"),
        F.count_if("is_ignored").alias("ignored_rows"), F.bool_or("has_header").alias("has_header"))


# ---- typed values ------------------------------------------------------------------------------


def parsed_date(text: Column) -> Column:
    """Date in one of the eight known forms, null when none fits."""
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]))


def _present(text: Column) -> Column:
    return text.isNotNull() & ~F.lower(stripped(text)).isin(*NULL_WORDS)


def parsed_int(text: Column) -> Column:
    return F.when(_present(text), F.regexp_replace(text, "[^0-9]", "").try_cast("int"))


def parsed_float(text: Column) -> Column:
    """Number, or percentage as a fraction."""
    bare = stripped(text)
    percent = F.replace(bare, F.lit("%"), F.lit("")).try_cast("double") / 100
    return F.when(_present(text), F.when(bare.contains("%"), percent).otherwise(bare.try_cast("double")))


def _bare_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^\\([^)]+\\)\\s*", ""), "\\s+\\[[A-Z]+\\]$", "")


def _name_matches(described: Column, name: Column) -> Column:
    clean = F.lower(F.trim(name))
    full = F.when(clean.contains("-"), F.replace(clean, F.lit("-"), F.lit(" "))).otherwise(clean)
    last = F.element_at(F.split(full, " "), -1)
    low = F.lower(described)
    low_last = F.element_at(F.split(F.trim(low), " +"), -1)
    return (low.contains(clean) | low.contains(full) | (last == low_last) | low_last.contains(last)
            | ((low_last != "") & last.contains(low_last)) | full.contains(low)
            | low.startswith(last) | low.startswith(full))


def _computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns that the optimizer does not merge into later steps: a value that
    several later conditions use is computed once per row."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def typed_matches(df: DataFrame) -> DataFrame:
    """Typed match rows from the pasted lines, valid or not, with an ``is_valid`` column.

    The loser's text is read to its end, break points stand at the documented place, and a date
    that cannot be read makes the row invalid.
    """
    rows = read_lines(df, TYPED_PATTERNS)
    rows = rows.withColumn("parts", split_fields(_left_stripped(F.col("line"))))
    mapped = F.col("column_map").isNotNull()
    tabbed = F.col("line").contains("\t")

    def part(i: Column) -> Column:
        return F.when(i >= 0, F.get("parts", i.cast("int")))

    def field(name: str, default: int) -> Column:
        return F.coalesce(part(F.coalesce(F.col("column_map")[name], F.lit(default))), F.lit(""))

    opp_place = F.coalesce(F.col("column_map")["opponent_rank"], F.lit(5))
    desc_place = F.coalesce(F.col("column_map")["match_description"], opp_place + 1)
    desc = F.when(tabbed, F.coalesce(part(desc_place), F.col("line"))).otherwise(F.col("line"))
    score_text = F.when(tabbed, F.coalesce(part(desc_place + 1), F.lit(""))).otherwise(F.col("line"))
    set_score = F.regexp_extract(score_text, SET_SCORE, 1)
    from_map = F.when(mapped & F.col("column_map")["score"].isNotNull(), field("score", -1)).otherwise("")
    plain_score = F.when(mapped, F.coalesce(part(F.lit(7)), F.lit(""))).otherwise("")
    score = F.when(from_map != "", from_map).when(set_score != "", set_score).otherwise(plain_score)

    after = F.coalesce(F.col("column_map")["score"], F.lit(7)) + 1
    positional = mapped | tabbed
    stats = ("dominance", "ace_pct", "df_pct", "first_in", "first_won", "second_won", "_points")
    own = {"first_in": "first_in_pct", "first_won": "first_won_pct", "second_won": "second_won_pct"}
    texts = {f"_t_{name}": F.when(positional, part(after + i)) for i, name in enumerate(stats)}
    texts.update({f"_o_{name}": F.when(F.col("column_map")[c].isNotNull(), field(c, -1)) for name, c in own.items()})
    texts.update({"_desc": desc, "_t_rank": field("rank", 4), "_t_opp": field("opponent_rank", 5), "_t_date": field("date", 0)})
    rows = _computed(rows.filter(F.size("parts") >= 3), {**texts, "score": score})
    desc = F.col("_desc")

    def stat(name: str) -> Column:
        value = parsed_float(F.col(f"_t_{name}"))
        return F.coalesce(parsed_float(F.col(f"_o_{name}")), value) if name in own else value

    ratio = stat("dominance")
    points = F.coalesce("_t__points", F.lit(""))
    saved = F.regexp_extract(points, "^([0-9]+)/([0-9]+)$", 1).try_cast("double")
    faced = F.regexp_extract(points, "^([0-9]+)/([0-9]+)$", 2).try_cast("double")
    left_text = F.regexp_extract(desc, "^(.+?)\\s+d\\.\\s+(.+)$", 1)
    right_text = F.regexp_extract(desc, "^(.+?)\\s+d\\.\\s+(.+)$", 2)
    rows = _computed(rows, {"_lefttext": left_text, "_righttext": right_text})
    typed = _computed(rows, {
        "match_date": parsed_date(F.col("_t_date")),
        "tournament": field("tournament", 1), "surface": field("surface", 2), "round": field("round", 3),
        "player_rank": parsed_int(F.col("_t_rank")), "opponent_rank": parsed_int(F.col("_t_opp")),
        "_left": _bare_name(F.col("_lefttext")), "_right": _bare_name(F.col("_righttext")),
        "_open": (F.col("_righttext") != "") & ~F.lower("line").contains(" vs "),
        "dominance": F.when(ratio > 0, ratio), "ace_pct": stat("ace_pct"), "df_pct": stat("df_pct"),
        "first_in": stat("first_in"), "first_won": stat("first_won"), "second_won": stat("second_won"),
        "break_points_saved": F.when(faced > 0, saved / faced),
    })
    named = F.col("player_name").isNotNull() & (F.col("player_name") != "")
    won = F.when(named, _name_matches(F.col("_left"), F.col("player_name"))).otherwise(
        (F.col("_t_rank") != "") & F.col("_lefttext").contains(F.col("_t_rank")))
    lost = F.when(named, _name_matches(F.col("_right"), F.col("player_name"))).otherwise(
        (F.col("_t_rank") != "") & F.col("_righttext").contains(F.col("_t_rank")))
    typed = _computed(typed, {"_won": won, "_lost": lost})
    won, lost = F.col("_won"), F.col("_lost")
    typed = typed.withColumns({
        "result": F.when(F.col("_open") & won, "W").when(F.col("_open") & lost, "L").otherwise(""),
        "opponent": F.when(~F.col("_open"), "").when(~won & lost, F.col("_left")).otherwise(F.col("_right")),
        "return_pct": return_from_dominance(),
    })
    return typed.withColumn("is_valid", valid_match()).drop(
        "_left", "_right", "_lefttext", "_righttext", "_open", "_won", "_lost", "fields", "parts", "column_map", *texts)


def return_from_dominance() -> Column:
    """``1 - serve / dominance`` where it is a share."""
    serve = F.col("first_in") * F.col("first_won") + (1 - F.col("first_in")) * F.col("second_won")
    value = 1 - serve / F.nullif(F.col("dominance"), F.lit(0.0))
    return F.when(value.between(0.0, 1.0), value)


def valid_match() -> Column:
    """Completed, both ranked, with serve numbers, a return share and a readable date."""
    low = F.lower(F.trim("score"))
    unfinished = low.rlike("ret|w/o|wo|def|walkover|w\\.o\\.") | low.isin("", "w.d.")
    needed = ("player_rank", "opponent_rank", "first_in", "first_won", "second_won", "return_pct", "match_date")
    complete = F.lit(True)
    for c in needed:
        complete = complete & F.col(c).isNotNull()
    return F.col("result").isin("W", "L") & ~unfinished & complete


def serve_stats_from_text(text: Column) -> dict[str, Column]:
    """Percentages after the score, in order, for lines without clear columns."""
    score = F.regexp_extract(text, SET_SCORE, 1)
    after = F.when(score != "", F.substr(text, F.instr(text, score) + F.length(score)))
    found = F.regexp_extract_all(after, F.lit("([0-9.]+%)"), F.lit(1))

    def at(i: int) -> Column:
        return parsed_float(F.get(found, F.lit(i)))

    saved = F.regexp_extract(after, "([0-9]+)/([0-9]+)", 1).try_cast("double")
    faced = F.regexp_extract(after, "([0-9]+)/([0-9]+)", 2).try_cast("double")
    return {"ace_pct": at(0), "df_pct": at(1), "first_in": at(2), "first_won": at(3), "second_won": at(4),
            "break_points_saved": F.when(faced > 0, saved / faced)}


def newest_valid(typed: DataFrame, n: int = 10, by: str = "doc_id") -> DataFrame:
    """The newest valid matches per text, or per player of several texts, with the number of valid
    ones and whether that suffices. Valid rows are stored, with all columns of ``typed``: they are read twice."""
    valid = cut_lineage(typed.filter("is_valid"))
    w = Window.partitionBy(by).orderBy(F.col("match_date").desc(), "row_index")
    totals = valid.groupBy(by).agg(F.count(F.lit(1)).alias("valid_matches"))
    picked = valid.withColumn("recent_no", F.row_number().over(w)).filter(F.col("recent_no") <= n)
    return picked.join(totals, by).withColumn("enough", F.col("valid_matches") >= n)


SERVE_POINTS = 120


def estimated_counts(rows: DataFrame) -> DataFrame:
    """Counts a match of about 120 serve points would have had with these percentages."""
    points = F.lit(SERVE_POINTS)

    def usable(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c) != 0)

    first = F.when(usable("first_in"), (F.col("first_in") * points).cast("int")).otherwise(F.lit(int(0.6 * SERVE_POINTS)))
    out = rows.withColumn("player_1stIn", first)
    second = points - F.col("player_1stIn")
    against = F.when(usable("return_pct"), 1.0 - F.col("return_pct")).otherwise(F.lit(0.5))
    total = (against * points).cast("int")
    out = out.withColumns({
        "player_svpt": points, "opp_svpt": points, "opp_1stIn": F.lit(int(0.6 * SERVE_POINTS)),
        "player_1stWon": F.when(usable("first_won"), (F.col("first_won") * F.col("player_1stIn")).cast("int")).otherwise(0),
        "player_2ndWon": F.when(usable("second_won"), (F.col("second_won") * second).cast("int")).otherwise(0),
        "player_bpSaved": F.coalesce("break_points_saved", F.lit(0.0)), "player_bpFaced": F.lit(10.0),
        "opp_bpSaved": F.lit(0.0), "opp_bpFaced": F.lit(10.0), "player_ace": F.lit(0.0), "player_df": F.lit(0.0),
        "opp_ace": F.lit(0.0), "opp_df": F.lit(0.0), "_total": total,
        "label": (F.col("result") == "W").cast("double"),
    })
    won_first = (F.col("_total") * 0.6).cast("int")
    return out.withColumns({"opp_1stWon": won_first, "opp_2ndWon": F.col("_total") - won_first}).drop("_total")
