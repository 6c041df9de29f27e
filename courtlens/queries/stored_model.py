"""The stored discriminant: styles, weights, sweep, batch scores and scored requests (families C29, D8, D16, E24, G2, G6, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtlens.functions import calibrate, names
from courtlens.operators import evaluate, orient
from courtlens.plans import asked, discriminant, features, scoring, styles
from courtlens.queries.base import cte, player_table, query, r6, rounded, sql_r6
from courtlens.queries.match_table import requests
from courtlens.queries.scoring import TRAIN_UNTIL, VALIDATE_UNTIL
from courtlens.queries import serving as _serving  # noqa: F401  (registers the request rows)
from courtlens.session import cut_lineage, passing, tidy
from courtlens.sources import tables

# ---- checking SQL: styles -----------------------------------------------------------------------

_TRAIN = f"tourney_date <= {TRAIN_UNTIL}"
_SPLIT = f"CASE WHEN {_TRAIN} THEN 'train' WHEN tourney_date <= {VALIDATE_UNTIL} THEN 'validation' ELSE 'test' END"
_S = scoring.STYLE_INPUT
_Z = ", ".join(f"z{i}" for i in range(len(_S)))
_CELLS = ", ".join(f"avg(z{i}) AS z{i}" for i in range(len(_S)))
_OLD = ", ".join(f"coalesce(n.z{i}, c.z{i}) AS z{i}" for i in range(len(_S)))
_AWAY = " + ".join(f"(z{i} - c[{i + 1}]) * (z{i} - c[{i + 1}])" for i in range(len(_S)))
_NEAREST = f"list_position(list_transform(cs, lambda c: {_AWAY}), list_min(list_transform(cs, lambda c: {_AWAY}))) - 1"
cte("style_z", ("edged",), "SELECT edged.*, " + ", ".join(f"(coalesce({c}, 0.0) - m{i}) / s{i} AS z{i}" for i, c in enumerate(_S)) + " FROM edged CROSS JOIN (SELECT " + ", ".join(
    f"avg(coalesce({c}, 0.0)) AS m{i}, coalesce(nullif(stddev_pop(coalesce({c}, 0.0)), 0), 1.0) AS s{i}" for i, c in enumerate(_S)) + f" FROM edged WHERE {_TRAIN})")
cte("style_round_0", ("style_z",), f"""
SELECT r.i, {", ".join(f"coalesce(z{i}, 0.0) AS z{i}" for i in range(len(_S)))} FROM range(4) r(i)
LEFT JOIN (SELECT CAST(z{_S.index(styles.START[0])} >= 0 AS INTEGER) * 2 + CAST(z{_S.index(styles.START[1])} >= 0 AS INTEGER) AS i, {_CELLS} FROM style_z WHERE {_TRAIN} GROUP BY 1) n ON n.i = r.i
""")
for _k in range(1, styles.ROUNDS + 1):
    cte(f"style_round_{_k}", ("style_z", f"style_round_{_k - 1}"), f"""
SELECT c.i, {_OLD} FROM style_round_{_k - 1} c LEFT JOIN (
  SELECT {_NEAREST} AS i, {_CELLS} FROM style_z CROSS JOIN (SELECT list([{_Z}] ORDER BY i) AS cs FROM style_round_{_k - 1}) WHERE {_TRAIN} GROUP BY 1) n ON n.i = c.i
""")
_STRONG = " + ".join(f"z{_S.index(c)}" for c in styles.STRENGTH)
cte("style_centres", (f"style_round_{styles.ROUNDS}",), f"SELECT row_number() OVER (ORDER BY {_STRONG}, i) - 1 AS style, {_Z} FROM style_round_{styles.ROUNDS}")
cte("styled", ("style_z", "style_centres"), f"""
SELECT style_z.* EXCLUDE ({_Z}), {_NEAREST} AS player_style_cluster FROM style_z CROSS JOIN (SELECT list([{_Z}] ORDER BY style) AS cs FROM style_centres)
""")
cte("matched_styles", ("styled",), """
SELECT a.*, coalesce(b.k, 0) AS opp_style_cluster, a.player_style_cluster * 10 + coalesce(b.k, 0) AS style_matchup
FROM styled a ASOF LEFT JOIN (SELECT player AS who, tourney_date * 10000000000 + match_num AS at, player_style_cluster AS k FROM styled) b
ON a.opponent = b.who AND a.tourney_date * 10000000000 + a.match_num >= b.at
""")

# ---- checking SQL: discriminant -----------------------------------------------------------------

_Q, _T = features.SEQUENCE_FEATURES, features.STATIC_FEATURES
_N = len(discriminant.NAMES)
_SIZE = len(_Q)
cte("windowed", ("matched_styles",), f"""
SELECT *, {_SPLIT} AS split FROM (SELECT player, opponent, match_id, match_num, tourney_date, label, count(*) OVER w AS steps,
  {", ".join(f'avg(coalesce("{f}", 0.0)) OVER w AS x{i}, avg(coalesce("{f}", 0.0) * coalesce("{f}", 0.0)) OVER w AS q{i}' for i, f in enumerate(_Q))},
  {", ".join(f'CAST(coalesce("{s}", 0.0) AS DOUBLE) AS x{_SIZE + i}' for i, s in enumerate(_T))}
  FROM matched_styles WINDOW w AS (PARTITION BY player ORDER BY tourney_date, match_num ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE steps = 10
""")
cte("lda_scaler", ("windowed",), "SELECT " + ", ".join(
    f"m{i}, CASE WHEN qq{i} - m{i} * m{i} > 1e-12 THEN sqrt(qq{i} - m{i} * m{i}) ELSE 1.0 END AS s{i}" if i < _SIZE else f"m{i}, s{i}" for i in range(_N)) + " FROM (SELECT " + ", ".join(
    f"avg(x{i}) AS m{i}, " + (f"avg(q{i}) AS qq{i}" if i < _SIZE else f"coalesce(nullif(stddev_pop(x{i}), 0), 1.0) AS s{i}") for i in range(_N)) + " FROM windowed WHERE split = 'train')")
_SCALED = "[" + ", ".join(f"(x{i} - m{i}) / s{i}" for i in range(_N)) + "]"
cte("lda_rows", ("windowed", "lda_scaler"), f"SELECT player, opponent, match_id, match_num, tourney_date, label, split, {_SCALED} AS v FROM windowed CROSS JOIN lda_scaler")


def _moments(name: str, label: str) -> None:
    cte(name, ("lda_rows",), f"""
SELECT i, avg(x) FILTER (y = 0) AS lost, avg(x) FILTER (y = 1) AS won,
  (count(*) FILTER (y = 0) * var_pop(x) FILTER (y = 0) + count(*) FILTER (y = 1) * var_pop(x) FILTER (y = 1)) / count(*) AS inside, avg(y) AS share
FROM (SELECT {label} AS y, unnest(v) AS x, unnest(range(1, {_N + 1})) AS i FROM lda_rows WHERE split = 'train') GROUP BY i
""")


def _weights(moments: str, shrinkage: str) -> str:
    return (f"SELECT list(w ORDER BY i) AS w, ln(any_value(share) / (1 - any_value(share))) - sum(w * (lost + won) / 2) AS b "
            f"FROM (SELECT *, (won - lost) / (inside + {shrinkage}) AS w FROM {moments})")


def _auc(rows: str, keys: str) -> str:
    return f"""
SELECT {keys}, (sum(CASE WHEN label = 1 THEN avg_rank ELSE 0 END) - p * (p + 1) / 2.0) / (p * n) AS auc FROM (
  SELECT *, sum(label) OVER (PARTITION BY {keys}) AS p, sum(1 - label) OVER (PARTITION BY {keys}) AS n,
    rank() OVER (PARTITION BY {keys} ORDER BY s) + (count(*) OVER (PARTITION BY {keys}, s) - 1) / 2.0 AS avg_rank FROM {rows}) GROUP BY {keys}, p, n"""


_PROB = "1 / (1 + exp(-(b + list_inner_product(v, w))))"
_FLIP = "CASE WHEN substr(md5(match_id || '_' || CAST(match_num AS VARCHAR)), 1, 1) < '8' THEN 1 - label ELSE label END"
_moments("lda_moments", "label")
_moments("lda_flipped", _FLIP)
cte("lda_model", ("lda_moments",), _weights("lda_moments", str(discriminant.SHRINKAGE)))

# ---- what the queries start from ----------------------------------------------------------------

_STORED: dict[tuple[str, str], tuple[str, str, str]] = {}
_ROW = ("player", "opponent", "match_num", "tourney_date", "label", "surface")
_COUNTS = ("player_ace", "player_df", *[f"{side}_{c}" for side in ("player", "opp") for c in ("svpt", "1stIn", "1stWon", "2ndWon")])
_OWN = (*scoring.STYLE_INPUT, "serve_skill", "return_skill", "serve_form_delta", "return_form_delta", "days_since_last_match")
_FACED = ("opp_serve_skill", "opp_return_skill", "player_style_cluster", "opp_player_style_cluster")


def _match_id(df):
    return df.withColumn("match_id", names.match_key(F.col("player"), F.col("opponent"), F.col("tourney_date")))


def _history(stored_rows):
    """The feature table from its stored columns: what follows from a row alone is not stored."""
    return features.faced_features(features.with_rolled_rates(stored_rows))


def stored(spark, folder):
    """(feature table, scaled rows with split, model) of a data folder: fitted and stored once per
    application, then read from the shared folder as a later job would.

    Styles need only a player's own rows. They are fitted first, so one as-of join brings the
    opponent's skills and style.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        places = tuple(tables.shared_folder(spark, name) for name in ("history", "windows", "model"))
        split = orient.temporal_split(F.col("tourney_date"), TRAIN_UNTIL, VALIDATE_UNTIL)
        counts = player_table(spark, folder).select(*_ROW, *_COUNTS)
        with passing(spark), tidy(spark):
            own = cut_lineage(features.own_features(counts).select(*_ROW, *_COUNTS, *_OWN))
            looks = styles.fit(own.where(split == "train"), stage=lambda d: d)
            faced = features.with_opponent_skills(looks.add(own), more=["player_style_cluster"])
            faced.select(*_ROW, *_COUNTS, *_OWN, *_FACED).write.parquet(places[0])

        def keep(rows):
            with tidy(spark):
                rows.write.parquet(places[1])
            return spark.read.parquet(places[1])

        fitted = discriminant.fit(spark.read.parquet(places[0]), split, fitted=looks, derive=_history, stage=keep)
        discriminant.write_model(spark, fitted.model, places[2])
        _STORED[key] = places
    history, windows, place = _STORED[key]
    model = discriminant.read_model(spark, place)
    table = _history(spark.read.parquet(history)).drop("player_style_cluster", "opp_player_style_cluster")
    return _match_id(table), _match_id(model.scaled(spark.read.parquet(windows))), model


def _with_auc(df, keys, prob):
    return evaluate.auc_by(df, keys, prob, "label")


# ---- styles -------------------------------------------------------------------------------------

@query("j03_stored_style_centres", "style_centres", " UNION ALL ".join(
    f"SELECT CAST(style AS INTEGER) AS style, '{c}' AS feature, round(z{i}, 6) + 0.0 AS centre FROM style_centres" for i, c in enumerate(_S)))
def _(spark, folder):
    _, _, model = stored(spark, folder)
    rows = [(k, f, v) for k, centre in enumerate(model.styles.centres) for f, v in zip(scoring.STYLE_INPUT, centre)]
    return rounded(spark.createDataFrame(rows, "style int, feature string, centre double"), ["style", "feature"], ["centre"])


@query("j03_nearest_styles_d02_c15", "matched_styles", """
SELECT player, match_num, CAST(player_style_cluster AS INTEGER) AS player_style_cluster, CAST(opp_style_cluster AS INTEGER) AS opp_style_cluster, CAST(style_matchup AS INTEGER) AS style_matchup FROM matched_styles
""")
def _(spark, folder):
    history, _, model = stored(spark, folder)
    out = discriminant.with_static(history, model.styles)
    return out.select("player", "match_num", *[F.col(c).cast("int").alias(c) for c in ("player_style_cluster", "opp_style_cluster", "style_matchup")])


# ---- model --------------------------------------------------------------------------------------

@query("j04_discriminant_weights", "lda_model", f"""
SELECT unnest([{", ".join(f"'{n}'" for n in discriminant.NAMES)}]) AS feature, round(unnest(w), 6) + 0.0 AS weight FROM lda_model
UNION ALL SELECT 'intercept', round(b, 6) + 0.0 FROM lda_model
""")
def _(spark, folder):
    _, _, model = stored(spark, folder)
    return rounded(spark.createDataFrame([*model.weights.items(), ("intercept", model.intercept)], "feature string, weight double"), ["feature"], ["weight"])


@query("j06_discriminant_batch_scores_j04", "lda_model lda_rows", f"""
SELECT match_id, match_num, least(player, opponent) AS player_one, round(avg(CASE WHEN player < opponent THEN p ELSE 1 - p END), 6) + 0.0 AS prob_one,
  CAST(max(CASE WHEN player < opponent THEN label ELSE 1 - label END) AS INTEGER) AS actual
FROM (SELECT *, {_PROB} AS p FROM lda_rows CROSS JOIN lda_model WHERE split = 'test') GROUP BY 1, 2, 3 HAVING count(*) = 2
""")
def _(spark, folder):
    _, scaled, model = stored(spark, folder)
    first = F.col("player") < F.col("opponent")
    rows = model.score(scaled.where("split = 'test'"))
    both = rows.groupBy("match_id", "match_num", F.least("player", "opponent").alias("player_one")).agg(
        F.avg(F.when(first, F.col("prob")).otherwise(1 - F.col("prob"))).alias("prob_one"),
        F.max(F.when(first, F.col("label")).otherwise(1 - F.col("label"))).cast("int").alias("actual"), F.count("*").alias("n"))
    return rounded(both.where("n = 2"), ["match_id", "match_num", "player_one", "actual"], ["prob_one"])


_SHOWN = [(n.removeprefix(discriminant.MEAN), n.startswith(discriminant.MEAN), i + 1) for i, n in enumerate(discriminant.NAMES)
          if n.removeprefix(discriminant.MEAN) not in discriminant.categories.HIDDEN_FEATURES]


@query("j09_discriminant_importance_g02_e24", "lda_model", f"""
SELECT feature, of_window, round(importance, 6) + 0.0 AS importance, round(importance / sum(importance) OVER () * 100, 6) + 0.0 AS share FROM (
  SELECT unnest([{", ".join(f"'{n}'" for n, _, _ in _SHOWN)}]) AS feature, unnest([{", ".join(str(m) for _, m, _ in _SHOWN)}]) AS of_window,
    abs(unnest([{", ".join(f"w[{i}]" for _, _, i in _SHOWN)}])) AS importance FROM lda_model ORDER BY importance DESC, feature, of_window LIMIT 20)
""")
def _(spark, folder):
    _, _, model = stored(spark, folder)
    table = discriminant.importance(spark, model).orderBy(F.col("importance").desc(), "feature", "of_window").limit(20)  # top 20 is the feature
    shares = scoring.importance_shares(cut_lineage(table))
    return rounded(shares, ["feature", "of_window"], ["importance", "share"])


_SHRINKAGES, _FINER = (0.003, 0.03, 0.3, 3.0, 30.0), (0.25, 0.5, 2.0, 4.0)


def _trials(values: str) -> str:
    rows = "(SELECT lambda_, label, round(1 / (1 + exp(-(b + list_inner_product(v, w)))), 9) AS s FROM lda_rows CROSS JOIN weights_of WHERE split = 'validation')"
    weights = ("SELECT lambda_, list(w ORDER BY i) AS w, ln(any_value(share) / (1 - any_value(share))) - sum(w * (lost + won) / 2) AS b "
               f"FROM (SELECT *, (won - lost) / (inside + lambda_) AS w FROM lda_moments CROSS JOIN ({values})) GROUP BY lambda_")
    return _auc(rows.replace("weights_of", f"({weights})"), "lambda_")


@query("j05_shrinkage_sweep_g06", "lda_moments", f"""
WITH one AS ({_trials("SELECT unnest([" + ", ".join(f"CAST({v} AS DOUBLE)" for v in _SHRINKAGES) + "]) AS lambda_")}),
best AS (SELECT lambda_ FROM one ORDER BY round(auc, 9) DESC, lambda_ LIMIT 1),
two AS ({_trials("SELECT lambda_ * unnest([" + ", ".join(f"CAST({v} AS DOUBLE)" for v in _FINER) + "]) AS lambda_ FROM best")}),
every AS (SELECT 1 AS stage, * FROM one UNION ALL SELECT 2, * FROM two)
SELECT CAST(stage AS INTEGER) AS stage, round(lambda_, 6) + 0.0 AS shrinkage, round(auc, 6) + 0.0 AS auc, row_number() OVER (ORDER BY round(auc, 9) DESC, lambda_) = 1 AS best FROM every
""")
def _(spark, folder):
    _, scaled, model = stored(spark, folder)
    fitted = discriminant.Fit(model, discriminant.moments(scaled.where("split = 'train'")), scaled)
    trials = discriminant.sweep(fitted, scaled.where("split = 'validation'"), _with_auc, _SHRINKAGES, _FINER)
    best = min(trials, key=lambda t: (-round(t[2], 9), t[1]))
    rows = [(*t, t == best) for t in trials]
    return rounded(spark.createDataFrame(rows, "stage int, shrinkage double, auc double, best boolean"), ["stage", "best"], ["shrinkage", "auc"])


@query("j10_discriminant_shuffled_labels", "lda_flipped", f"""
WITH flipped_model AS ({_weights("lda_flipped", str(discriminant.SHRINKAGE))}),
r AS (SELECT 'test' AS split, label, round({_PROB}, 9) AS s FROM lda_rows CROSS JOIN flipped_model WHERE split = 'test')
SELECT split, round(auc, 6) + 0.0 AS auc FROM ({_auc("r", "split")})
""")
def _(spark, folder):
    _, scaled, model = stored(spark, folder)
    flip = F.substring(F.md5(F.concat_ws("_", "match_id", F.col("match_num").cast("string"))), 1, 1) < "8"
    train = scaled.where("split = 'train'").withColumn("label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))
    w, b = discriminant.moments(train).weights(discriminant.SHRINKAGE)
    other = discriminant.Model(model.sequence_scaler, model.static_scaler, model.styles, dict(zip(discriminant.NAMES, w)), b)
    scored = other.score(scaled.where("split = 'test'")).withColumn("prob", F.round("prob", 9))
    return rounded(_with_auc(scored, ["split"], "prob"), ["split"], ["auc"])


# ---- requests -----------------------------------------------------------------------------------

cte("asked_rows", ("request_rows",), """
SELECT id AS request_id, CASE WHEN id % 10 = 7 THEN a || ' II' ELSE a END AS player, b AS opponent, CASE WHEN id % 10 = 3 THEN 19900101 ELSE tourney_date END AS tourney_date,
  CASE id % 3 WHEN 0 THEN 'Clay' WHEN 1 THEN 'Grass' END AS surface
FROM (SELECT match_num - 9000000000000000 AS id, tourney_date, CASE WHEN match_num % 2 = 0 THEN opponent ELSE player END AS a, CASE WHEN match_num % 2 = 0 THEN player ELSE opponent END AS b FROM request_rows)
""")
cte("asked_sides", ("asked_rows",), """
SELECT *, 1 AS side FROM asked_rows UNION ALL SELECT request_id, opponent, player, tourney_date, surface, 2 FROM asked_rows
""")
_TEN = "FILTER (back <= 10)"
_MEAN_OF = {r: f"avg({r}) {_TEN}" for r in features.ROLLED}
cte("asked_state", ("asked_sides", "styled"), f"""
SELECT request_id, side, count(*) {_TEN} AS steps,
  0.4*{_MEAN_OF['player_1st_win_pct']} + 0.4*{_MEAN_OF['player_2nd_win_pct']} + 0.1*{_MEAN_OF['player_ace_rate']} - 0.1*{_MEAN_OF['player_df_rate']} AS serve,
  0.5*{_MEAN_OF['player_1st_return_win_pct']} + 0.5*{_MEAN_OF['player_2nd_return_win_pct']} AS ret,
  {", ".join(f'avg(coalesce("{f}", 0.0)) {_TEN} AS x{i}' for i, f in enumerate(_Q))}, {", ".join(f"avg({c.removesuffix('_roll30')}) AS r{i}" for i, c in enumerate(_S))}
FROM (SELECT a.request_id, a.side, s.*, row_number() OVER (PARTITION BY request_id, side ORDER BY s.tourney_date DESC, s.match_num DESC) AS back
  FROM asked_sides a JOIN styled s ON s.player = a.player AND s.tourney_date < a.tourney_date) WHERE back <= 30 GROUP BY 1, 2
""")
cte("asked_opponent", ("asked_sides", "styled"), """
SELECT a.request_id, a.side, s.serve_skill AS os, s.return_skill AS orr, s.player_style_cluster AS k FROM asked_sides a JOIN styled s ON s.player = a.opponent AND s.tourney_date < a.tourney_date
QUALIFY row_number() OVER (PARTITION BY request_id, side ORDER BY s.tourney_date DESC, s.match_num DESC) = 1
""")
_RZ = [f"(r{i} - rm{i}) / rs{i}" for i in range(len(_S))]
_RAWAY = " + ".join(f"({z} - c[{i + 1}]) * ({z} - c[{i + 1}])" for i, z in enumerate(_RZ))
_RNEAREST = f"list_position(list_transform(cs, lambda c: {_RAWAY}), list_min(list_transform(cs, lambda c: {_RAWAY}))) - 1"
_EDGES = ["serve - orr", "ret - os", "serve - orr + (ret - os)"]
_STATIC_SQL = [*_EDGES, *[f"CAST(coalesce(surface, 'Hard') = '{s}' AS DOUBLE)" for s in ("Hard", "Clay", "Grass")], "own_style::DOUBLE", "k::DOUBLE", "(own_style * 10 + k)::DOUBLE"]
cte("asked_values", ("asked_sides", "asked_state", "asked_opponent", "style_centres", "edged"), f"""
SELECT request_id, side, steps, status, {", ".join(f"x{i}" for i in range(_SIZE))}, {", ".join(f"{s} AS x{_SIZE + i}" for i, s in enumerate(_STATIC_SQL))} FROM (
  SELECT a.request_id, a.side, a.surface, coalesce(steps, 0) AS steps, coalesce(serve, 0.0) AS serve, coalesce(ret, 0.0) AS ret, coalesce(os, 0.0) AS os, coalesce(orr, 0.0) AS orr, coalesce(k, 0) AS k,
    CASE WHEN steps > 0 THEN {_RNEAREST} ELSE 0 END AS own_style, {", ".join(f"coalesce(x{i}, 0.0) AS x{i}" for i in range(_SIZE))},
    CASE WHEN a.player NOT IN (SELECT player FROM edged) OR a.opponent NOT IN (SELECT player FROM edged) THEN '{asked.UNKNOWN}' WHEN steps > 0 THEN '{asked.OK}' ELSE '{asked.NO_HISTORY}' END AS status
  FROM asked_sides a LEFT JOIN asked_state s USING (request_id, side) LEFT JOIN asked_opponent o USING (request_id, side)
  CROSS JOIN (SELECT list([{_Z}] ORDER BY style) AS cs FROM style_centres)
  CROSS JOIN (SELECT {", ".join(f"avg(coalesce({c}, 0.0)) AS rm{i}, coalesce(nullif(stddev_pop(coalesce({c}, 0.0)), 0), 1.0) AS rs{i}" for i, c in enumerate(_S))} FROM edged WHERE {_TRAIN}))
""")
cte("asked_scaled", ("asked_values", "lda_scaler"), f"SELECT request_id, side, steps, status, {_SCALED} AS v FROM asked_values CROSS JOIN lda_scaler")
cte("fresh_scores", ("asked_scaled", "lda_model"), f"""
SELECT request_id, CASE WHEN max(status) FILTER (side = 1) = '{asked.OK}' THEN (max(p) FILTER (side = 1) + 1 - max(p) FILTER (side = 2)) / 2 END AS prob_one, max(status) FILTER (side = 1) AS status
FROM (SELECT *, {_PROB} AS p FROM asked_scaled CROSS JOIN lda_model) GROUP BY request_id
""")
cte("frozen_scores", ("asked_rows", "lda_rows", "lda_model"), f"""
SELECT a.request_id, a.player > a.opponent AS swapped, m.match_num AS sample, CASE WHEN a.player > a.opponent THEN 1 - (p + 1 - q) / 2 ELSE (p + 1 - q) / 2 END AS prob_one FROM asked_rows a LEFT JOIN (
  SELECT x.player AS lo, x.opponent AS hi, x.match_num, x.p, y.p AS q FROM (SELECT *, {_PROB} AS p FROM lda_rows CROSS JOIN lda_model) x JOIN (SELECT *, {_PROB} AS p FROM lda_rows CROSS JOIN lda_model) y
    ON x.player < x.opponent AND y.player = x.opponent AND y.opponent = x.player AND y.match_num = x.match_num AND y.tourney_date = x.tourney_date
  QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY x.tourney_date DESC, x.match_num DESC) = 1) m ON m.lo = least(a.player, a.opponent) AND m.hi = greatest(a.player, a.opponent)
""")


def asked_rows(spark, folder):
    """Neighbouring players on one date; some asked the other way round, some by an unknown name,
    some before any match, some without a surface."""
    base = requests(spark, folder).withColumn("request_id", F.col("match_num") - 9000000000000000)
    turned = F.col("match_num") % 2 == 0
    player = F.when(turned, F.col("opponent")).otherwise(F.col("player"))
    case = F.col("request_id") % 10
    return base.select(
        "request_id", F.when(case == 7, F.concat(player, F.lit(" II"))).otherwise(player).alias("player"),
        F.when(turned, F.col("player")).otherwise(F.col("opponent")).alias("opponent"),
        F.when(case == 3, 19900101).otherwise(F.col("tourney_date")).alias("tourney_date"),
        F.when(F.col("request_id") % 3 == 0, "Clay").when(F.col("request_id") % 3 == 1, "Grass").alias("surface"))


@query("j12_scaled_request_vectors", "asked_scaled", f"""
SELECT request_id, CAST(side AS INTEGER) AS side, CAST(steps AS INTEGER) AS steps, status, {", ".join(f'round(v[{i + 1}], 6) + 0.0 AS "{n}"' for i, n in enumerate(discriminant.NAMES))} FROM asked_scaled
""")
def _(spark, folder):
    history, _, model = stored(spark, folder)
    values = model.scaled(asked.request_values(history, asked.both_sides(asked_rows(spark, folder)), model))
    return rounded(values, ["request_id", "side", "steps", "status"], list(discriminant.NAMES))


@query("j06_scored_requests", "fresh_scores", f"""
SELECT request_id, status, round(prob_one, 6) + 0.0 AS raw_probability, round(t, 6) + 0.0 AS prob_one, round(greatest(t, 1 - t), 6) + 0.0 AS confidence
FROM (SELECT *, 1 / (1 + exp(-ln(greatest(least(prob_one, 1 - 1e-6), 1e-6) / (1 - greatest(least(prob_one, 1 - 1e-6), 1e-6))) / {calibrate.AS_AT_TEMPERATURE})) AS t FROM fresh_scores)
""")
def _(spark, folder):
    history, _, model = stored(spark, folder)
    out = asked.fresh(history, asked_rows(spark, folder), model).withColumn(
        "t", calibrate.with_temperature(F.col("prob_one"), F.lit(calibrate.AS_AT_TEMPERATURE)))
    return out.select("request_id", "status", r6("prob_one").alias("raw_probability"), r6("t").alias("prob_one"), r6(F.greatest("t", 1 - F.col("t"))).alias("confidence"))


def _two_sources(spark, folder):
    history, scaled, model = stored(spark, folder)
    rows = asked_rows(spark, folder)
    old = asked.frozen(scaled, rows, model).select("request_id", "swapped", "sample", F.col("prob_one").alias("frozen"))
    return old.join(asked.fresh(history, rows, model).withColumnRenamed("prob_one", "fresh"), "request_id")


@query("d16_frozen_sample_and_fresh_state_d08", "frozen_scores fresh_scores", """
SELECT request_id, swapped, sample, round(z.prob_one, 6) + 0.0 AS frozen, round(f.prob_one, 6) + 0.0 AS fresh, status FROM frozen_scores z JOIN fresh_scores f USING (request_id)
""")
def _(spark, folder):
    return rounded(_two_sources(spark, folder), ["request_id", "swapped", "sample", "status"], ["frozen", "fresh"])


@query("c29_fresh_state_minus_frozen_sample", "frozen_scores fresh_scores", """
SELECT request_id, round(f.prob_one - z.prob_one, 6) + 0.0 AS probability_delta, f.prob_one IS NOT NULL AS override_used FROM frozen_scores z JOIN fresh_scores f USING (request_id)
""")
def _(spark, folder):
    both = _two_sources(spark, folder)
    return both.select("request_id", r6(F.col("fresh") - F.col("frozen")).alias("probability_delta"), F.col("fresh").isNotNull().alias("override_used"))
