"""Pasted match-history text (families I, E26, G3, C40-C41)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.operators import pasted
from courtlens.queries.base import cte, player_table, query, r6, rounded, sql_r6
from courtlens.sources import derived

_B = r"[ \t\r\f\x0B]"


def texts(spark, folder):
    return derived.pasted_texts(player_table(spark, folder, "tourney_name", "round", "score"))


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def _percent(num: str, den: str) -> str:
    x = f"((1000*{num}) // {den})"
    return f"CASE WHEN {den} <= 0 THEN '' ELSE concat({x} // 10, '.', {x} % 10, '%') END"


def _pasted_sql() -> str:
    ratio = "((100*(player_1stWon+player_2ndWon)*opp_svpt) // (player_svpt*(opp_1stWon+opp_2ndWon)))"
    own = "coalesce(CAST(CAST(player_rank AS INTEGER) AS VARCHAR), '-')"
    other = "coalesce(CAST(CAST(opponent_rank AS INTEGER) AS VARCHAR), '-')"
    verb = "CASE WHEN match_num % 23 = 0 THEN ' vs ' ELSE ' d. ' END"
    me, you = f"concat('(', {own}, ')', player)", f"concat('(', {other}, ')', opponent)"
    parts = [
        "strftime(day, '%d-%b-%Y')", "tourney_name", "coalesce(surface, '')", "round", own, other,
        f"CASE WHEN label = 1 THEN concat({me}, {verb}, {you}, ' [FRA]') ELSE concat({you}, ' [ESP]', {verb}, {me}) END", "score",
        f"CASE WHEN player_svpt*(opp_1stWon+opp_2ndWon) = 0 THEN '' ELSE concat({ratio} // 100, '.', lpad(CAST({ratio} % 100 AS VARCHAR), 2, '0')) END",
        _percent("player_ace", "player_svpt"), _percent("player_df", "player_svpt"), _percent("player_1stIn", "player_svpt"),
        _percent("player_1stWon", "player_1stIn"), _percent("player_2ndWon", "(player_svpt-player_1stIn)"),
        "concat(player_bpSaved, '/', player_bpFaced)", "'1:45'",
    ]
    header = derived.HEADER.replace("\t", "' || chr(9) || '")
    return f"""
SELECT CAST(substr(player, 10) AS BIGINT) * 10000 + tourney_date // 10000 AS doc_id, player AS player_name,
  CASE WHEN CAST(right(player, 1) AS INTEGER) % 2 = 0 THEN '{header}' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY tourney_date DESC, match_num DESC) AS text
FROM (SELECT player, tourney_date, match_num, concat_ws(chr(9), {", ".join(parts)}) AS line FROM dual)
GROUP BY player, tourney_date // 10000
"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def _lines(text: str) -> str:
    clean = f"regexp_replace({_strip('p')}, ' +', ' ', 'g')"
    return (f"list_transform(list_filter(string_split({text}, chr(10)), lambda x: {_strip('x')} <> ''), "
            f"lambda x: array_to_string(list_transform(string_split(regexp_replace(x, '{_B}+$', ''), chr(9)), lambda p: {clean}), chr(9)))")


def _words(x: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), '{w}') AS INTEGER)" for w in pasted.HEADER_WORDS) + ")"


def _header_at(lines: str) -> str:
    return f"CAST(coalesce(list_position(list_transform({lines}[1:5], lambda x: {_words('x')} >= 3), true), 0) - 1 AS INTEGER)"


def _fields(x: str) -> str:
    return (f"list_transform(CASE WHEN contains({x}, chr(9)) THEN string_split({x}, chr(9)) "
            f"WHEN len(string_split_regex({x}, '{_B}{{2,}}')) > 1 THEN string_split_regex({x}, '{_B}{{2,}}') "
            f"ELSE string_split_regex({x}, '{_B}+') END, lambda f: {_strip('f')})")


cte("pasted", ("dual",), _pasted_sql())
cte("pasted_lines", ("pasted",), f"""
SELECT doc_id, player_name, h >= 0 AS has_header, CAST(i - 1 AS INTEGER) AS row_index, lines[i] AS line, {_fields('lines[i]')} AS fields
FROM (SELECT *, {_header_at('lines')} AS h FROM (SELECT doc_id, player_name, {_lines('text')} AS lines FROM pasted)), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
WHERE i - 1 > h
""")
cte("document_lines", (), f"""
SELECT doc_id, h, CAST(i - 1 AS INTEGER) AS row_index, lines[i] AS line
FROM (SELECT *, {_header_at('lines')} AS h FROM (SELECT doc_id, {_lines('text')} AS lines FROM documents)), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
""")


@query("i01_normalised_lines", "document_lines", "SELECT doc_id, row_index, line FROM document_lines")
def _(spark, folder):
    df = documents(spark, folder)
    return df.select("doc_id", F.posexplode(pasted.normalised_lines(F.col("text"))).alias("row_index", "line"))


@query("i01_pasted_lines", "pasted_lines", "SELECT doc_id, row_index, line FROM pasted_lines")
def _(spark, folder):
    return pasted.read_lines(texts(spark, folder)).select("doc_id", "row_index", "line")


@query("i02_header_lines", "pasted", f"""
SELECT doc_id, {_header_at('lines')} AS header_index FROM (SELECT doc_id, {_lines('text')} AS lines FROM pasted)
UNION ALL SELECT 1000000000 + doc_id, {_header_at('lines')} FROM (SELECT doc_id, {_lines('text')} AS lines FROM documents)
""")
def _(spark, folder):
    both = texts(spark, folder).select("doc_id", "text").unionByName(
        documents(spark, folder).withColumn("doc_id", F.col("doc_id") + 1000000000))
    return both.select("doc_id", pasted.header_index(pasted.normalised_lines(F.col("text"))).alias("header_index"))


def _label_case(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in pasted.DISPLAY_PATTERNS) + " END"


@query("i03_column_maps", "pasted", f"""
WITH cols AS (SELECT doc_id, i - 1 AS i, {_label_case("lower(" + _strip("c[i]") + ")")} AS key FROM (
  SELECT doc_id, string_split(lines[h + 1], chr(9)) AS c FROM (SELECT doc_id, lines, {_header_at('lines')} AS h FROM (SELECT doc_id, {_lines('text')} AS lines FROM pasted)) WHERE h >= 0),
  LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)),
named AS (SELECT doc_id, key, max(i) AS value FROM cols WHERE key IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, key, CAST(value AS INTEGER) AS value FROM named
UNION ALL SELECT c.doc_id, 'match_description', CAST(min(c.i) AS INTEGER) FROM cols c JOIN named o ON o.doc_id = c.doc_id AND o.key = 'opponent_rank' JOIN named s ON s.doc_id = c.doc_id AND s.key = 'score'
  WHERE c.key IS NULL AND c.i > o.value AND c.i < s.value GROUP BY 1
""")
def _(spark, folder):
    rows = pasted.read_lines(texts(spark, folder)).filter("column_map IS NOT NULL")
    first = rows.filter(F.col("row_index") == 1)
    return first.select("doc_id", F.explode("column_map").alias("key", "value"))


@query("i04_fields", "pasted_lines", """
SELECT doc_id, row_index, CAST(k AS INTEGER) AS place, fields[k] AS value FROM pasted_lines, LATERAL (SELECT unnest(range(1, len(fields) + 1)) AS k)
""")
def _(spark, folder):
    rows = pasted.read_lines(texts(spark, folder))
    return rows.select("doc_id", "row_index", F.posexplode("fields").alias("i", "value")).select(
        "doc_id", "row_index", (F.col("i") + 1).alias("place"), "value")


@query("i04_document_field_counts", "document_lines", f"""
SELECT doc_id, row_index, CAST(len({_fields('line')}) AS INTEGER) AS n FROM document_lines WHERE row_index > h
""")
def _(spark, folder):
    return pasted.read_lines(documents(spark, folder)).select("doc_id", "row_index", F.size("fields").alias("n"))


def _any(place: str, *marks: str) -> str:
    return "(" + " OR ".join(f"contains({place}, '{m}')" for m in marks) + ")"


def _flag_sql(place: str) -> str:
    null = "('', '-', '—', '–', 'na', 'n/a', 'nan', '.')"
    return f"""
SELECT *, contains(lower(line), ' vs ') AS is_upcoming, {_any(place, 'w/o', 'wo', 'walkover')} AS is_walkover, {_any(place, 'ret', 'retirement', 'retired')} AS is_retirement,
  len(fields) < 3 OR (has_header AND (lower(fields[5]) IN {null} OR lower(fields[6]) IN {null})) AS is_incomplete,
  list_filter([CASE WHEN len(fields) < 3 THEN 'Too few fields' END, CASE WHEN has_header AND lower(fields[5]) IN {null} THEN 'Missing Rk' WHEN has_header AND lower(fields[6]) IN {null} THEN 'Missing vRk' END], lambda e: e IS NOT NULL) AS parse_errors,
  {_words("array_to_string(fields[1:5], ' ')")} >= 2 AS is_header
FROM pasted_lines
"""


cte("pasted_flags", ("pasted_lines",), _flag_sql("lower(line)"))
cte("pasted_score_flags", ("pasted_lines",), _flag_sql("lower(coalesce(fields[8], ''))"))
cte("pasted_display", ("pasted_flags",), """
SELECT *, list_concat(list_filter([CASE WHEN is_walkover THEN 'Walkover' END, CASE WHEN is_retirement THEN 'Retirement' END, CASE WHEN is_upcoming THEN 'Upcoming match' END,
  CASE WHEN is_incomplete THEN 'Incomplete data' END], lambda e: e IS NOT NULL), parse_errors) AS ignore_reasons FROM pasted_flags WHERE NOT is_header
""")
_FLAGS = "doc_id, row_index, is_upcoming, is_walkover, is_retirement, is_incomplete, array_to_string(parse_errors, '; ') AS parse_errors"


def _flag_columns(rows):
    return rows.select("doc_id", "row_index", "is_upcoming", "is_walkover", "is_retirement", "is_incomplete",
                       F.array_join("parse_errors", "; ").alias("parse_errors"))


@query("i05_row_flags_literal", "pasted_flags", f"SELECT {_FLAGS} FROM pasted_flags")
def _(spark, folder):
    return _flag_columns(pasted.with_flags(pasted.read_lines(texts(spark, folder)), literal=True))


@query("i05_row_flags_by_score", "pasted_score_flags", f"SELECT {_FLAGS} FROM pasted_score_flags")
def _(spark, folder):
    return _flag_columns(pasted.with_flags(pasted.read_lines(texts(spark, folder)), literal=False))


def display(spark, folder):
    return pasted.for_display(pasted.with_flags(pasted.read_lines(texts(spark, folder))))


@query("i06_ignore_reasons", "pasted_display", "SELECT doc_id, row_index, len(ignore_reasons) > 0 AS is_ignored, array_to_string(ignore_reasons, '; ') AS ignore_reasons FROM pasted_display")
def _(spark, folder):
    return display(spark, folder).select("doc_id", "row_index", "is_ignored", F.array_join("ignore_reasons", "; ").alias("ignore_reasons"))


@query("i07_tuned_fields", "pasted_display", """
SELECT doc_id, row_index, CAST(coalesce(list_max(list_transform(range(1, len(fields) + 1), lambda k: CASE WHEN fields[k] <> '' THEN k ELSE 1 END)), 1) AS INTEGER) AS n_fields,
  array_to_string(list_filter(fields, lambda f: f <> ''), ', ') AS formatted_line FROM pasted_display
""")
def _(spark, folder):
    return pasted.tuned(display(spark, folder)).select("doc_id", "row_index", F.size("fields").alias("n_fields"), "formatted_line")


@query("e26_parse_summary", "pasted_display", """
SELECT doc_id, count(*) AS total_rows, count(*) FILTER (WHERE len(ignore_reasons) = 0) AS valid_matches, count(*) FILTER (WHERE len(ignore_reasons) > 0) AS ignored_rows, bool_or(has_header) AS has_header FROM pasted_display GROUP BY 1
""")
def _(spark, folder):
    return pasted.parse_summary(display(spark, folder))


# ---- typed values -------------------------------------------------------------------------------

def _number(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('', '-', 'na', 'n/a', 'nan', '.', '..', 'null') THEN NULL WHEN contains({x}, '%') THEN TRY_CAST(replace({x}, '%', '') AS DOUBLE) / 100 ELSE TRY_CAST({x} AS DOUBLE) END"


def _int(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('', '-', 'na', 'n/a', 'nan', '.', '..', 'null') THEN NULL ELSE TRY_CAST(regexp_replace({x}, '[^0-9]', '', 'g') AS INTEGER) END"


_SCORE = r"([0-9]+-[0-9]+(?:\([0-9]+\))?(?:\s+[0-9]+-[0-9]+(?:\([0-9]+\))?)+)"


def _bare(x: str) -> str:
    return rf"regexp_replace(regexp_replace(trim({x}), '^\([^)]+\)\s*', ''), '\s+\[[A-Z]+\]$', '')"


cte("typed", ("pasted_lines",), rf"""
SELECT *, CASE WHEN 1 - serve / dominance BETWEEN 0 AND 1 THEN 1 - serve / dominance END AS return_pct FROM (
  SELECT *, first_in * first_won + (1 - first_in) * second_won AS serve,
    CASE WHEN open AND contains(lower(l), lower(player_name)) THEN 'W' WHEN open AND contains(lower(r), lower(player_name)) THEN 'L' ELSE '' END AS result,
    CASE WHEN NOT open THEN '' WHEN NOT contains(lower(l), lower(player_name)) AND contains(lower(r), lower(player_name)) THEN l ELSE r END AS opponent
  FROM (SELECT doc_id, player_name, row_index, CAST(try_strptime(fields[1], '%d-%b-%Y') AS DATE) AS match_date, fields[2] AS tournament, fields[3] AS surface, fields[4] AS round,
    {_int('fields[5]')} AS player_rank, {_int('fields[6]')} AS opponent_rank,
    CASE WHEN has_header THEN fields[8] ELSE regexp_extract(fields[8], '{_SCORE}', 1) END AS score,
    {_bare(r"regexp_extract(fields[7], '^(.+?)\s+d\.\s+(.+)$', 1)")} AS l, {_bare(r"regexp_extract(fields[7], '^(.+?)\s+d\.\s+(.+)$', 2)")} AS r,
    contains(fields[7], ' d. ') AS open, CASE WHEN {_number('fields[9]')} > 0 THEN {_number('fields[9]')} END AS dominance,
    {_number('fields[10]')} AS ace_pct, {_number('fields[11]')} AS df_pct, {_number('fields[12]')} AS first_in, {_number('fields[13]')} AS first_won, {_number('fields[14]')} AS second_won,
    TRY_CAST(regexp_extract(fields[15], '^([0-9]+)/([0-9]+)$', 1) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(fields[15], '^([0-9]+)/([0-9]+)$', 2) AS DOUBLE), 0) AS break_points_saved
  FROM pasted_lines WHERE len(fields) >= 3))
""")
cte("typed_valid", ("typed",), r"""
SELECT *, result IN ('W', 'L') AND NOT regexp_matches(lower(score), 'ret|w/o|wo|def|walkover|w\.o\.') AND score <> '' AND player_rank IS NOT NULL AND opponent_rank IS NOT NULL
  AND first_in IS NOT NULL AND first_won IS NOT NULL AND second_won IS NOT NULL AND return_pct IS NOT NULL AND match_date IS NOT NULL AS is_valid FROM typed
""")


def typed(spark, folder):
    return pasted.typed_matches(texts(spark, folder))


_DR = ["doc_id", "row_index"]


@query("i08_typed_values", "typed", f"SELECT doc_id, row_index, match_date, tournament, surface, round, player_rank, opponent_rank FROM typed")
def _(spark, folder):
    return typed(spark, folder).select(*_DR, "match_date", "tournament", "surface", "round", "player_rank", "opponent_rank")


@query("i09_results_and_opponents", "typed", "SELECT doc_id, row_index, result, opponent FROM typed")
def _(spark, folder):
    return typed(spark, folder).select(*_DR, "result", "opponent")


_I10 = ["dominance", "ace_pct", "df_pct", "first_in", "first_won", "second_won", "break_points_saved"]


@query("i10_scores_and_serve_stats", "typed", f"SELECT doc_id, row_index, score, {sql_r6(*_I10)} FROM typed")
def _(spark, folder):
    return rounded(typed(spark, folder), [*_DR, "score"], _I10)


@query("i10_serve_stats_from_text", "pasted_lines", rf"""
SELECT doc_id, row_index, {", ".join(f"round(TRY_CAST(replace(p[{i}], '%', '') AS DOUBLE) / 100, 6) + 0.0 AS {n}" for i, n in enumerate(["ace_pct", "df_pct", "first_in", "first_won", "second_won"], 1))}
FROM (SELECT doc_id, row_index, regexp_extract_all(CASE WHEN s <> '' THEN substr(line, strpos(line, s) + length(s)) ELSE '' END, '([0-9.]+%)') AS p
  FROM (SELECT *, regexp_extract(line, '{_SCORE}', 1) AS s FROM pasted_lines))
""")
def _(spark, folder):
    rows = pasted.read_lines(texts(spark, folder))
    stats = pasted.serve_stats_from_text(F.col("line"))
    names = ["ace_pct", "df_pct", "first_in", "first_won", "second_won"]
    return rows.select(*_DR, *[r6(stats[n]).alias(n) for n in names])


@query("i11_valid_matches_c41_return_share", "typed_valid", "SELECT doc_id, row_index, is_valid, round(return_pct, 6) + 0.0 AS return_pct FROM typed_valid")
def _(spark, folder):
    return typed(spark, folder).select(*_DR, "is_valid", r6("return_pct").alias("return_pct"))


@query("g03_newest_valid_matches", "typed_valid", """
SELECT doc_id, row_index, match_date, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY match_date DESC, row_index) AS INTEGER) AS recent_no, count(*) OVER (PARTITION BY doc_id) AS valid_matches,
  count(*) OVER (PARTITION BY doc_id) >= 10 AS enough FROM typed_valid WHERE is_valid QUALIFY recent_no <= 10
""")
def _(spark, folder):
    return pasted.newest_valid(typed(spark, folder).select(*_DR, "match_date", "is_valid")).select(*_DR, "match_date", "recent_no", "valid_matches", "enough")


_C40 = ["player_1stIn", "player_1stWon", "player_2ndWon", "opp_1stWon", "opp_2ndWon"]


@query("c40_estimated_counts", "typed_valid", """
SELECT doc_id, row_index, f AS "player_1stIn", CAST(trunc(first_won * f) AS INTEGER) AS "player_1stWon", CAST(trunc(second_won * (120 - f)) AS INTEGER) AS "player_2ndWon",
  CAST(trunc(t * 0.6::DOUBLE) AS INTEGER) AS "opp_1stWon", t - CAST(trunc(t * 0.6::DOUBLE) AS INTEGER) AS "opp_2ndWon"
FROM (SELECT *, CAST(trunc(CASE WHEN first_in <> 0 THEN first_in * 120 ELSE 72 END) AS INTEGER) AS f, CAST(trunc((1.0 - return_pct) * 120) AS INTEGER) AS t FROM typed_valid WHERE is_valid)
""")
def _(spark, folder):
    return pasted.estimated_counts(typed(spark, folder).filter("is_valid")).select(*_DR, *_C40)
