"""A linear discriminant over the window's means and the static values, kept as tables.

Weights follow in closed form from class means and the variance inside the classes, so fitting is
one aggregate and several shrinkages cost no further pass. Steps of the window share one weight per
feature: the model reads the mean of the valid steps. Both scalers, the style centres, the weights
and the intercept are one stored table, which other jobs read to score whatever has the columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from courtlens.functions import categories, rates
from courtlens.operators.asof import asof_join
from courtlens.operators.timeline import history_columns, longer_sums, rows_before
from courtlens.plans import features, styles
from courtlens.plans.scoring import STYLE_INPUT, Scaler, fit_static_scaler, style_matchup
from courtlens.session import cut_lineage

MEAN = "mean_"
FIELDS = tuple(MEAN + f for f in features.SEQUENCE_FEATURES)
NAMES = FIELDS + features.STATIC_FEATURES
SHRINKAGE = 0.1
ROW = ("player", "opponent", "match_id", "match_num", "tourney_date", "label")


# ---- rows ----------------------------------------------------------------------------------------


def with_window_means(df: DataFrame, derive=lambda d: d) -> DataFrame:
    """Mean and mean square of each sequence feature over the previous ten rows, and their number.
    ``derive`` may add the features after the rows are dealt by player."""
    def build(w):
        value = {f: rates.finite_or_zero(F.col(f)) for f in features.SEQUENCE_FEATURES}
        every = {**{"_" + MEAN + f: v for f, v in value.items()}, **{"_square_" + f: v * v for f, v in value.items()}}
        half, n = features.SEQ_LEN // 2, F.col("_rows")
        sums = {"_half" + name: F.sum(v).over(w.rowsBetween(-half, -1)) for name, v in every.items()}
        return [sums | {"_rows": rows_before(w, features.SEQ_LEN)}, longer_sums(w, {name: "_half" + name for name in every}, features.SEQ_LEN, half),
                {**{name[1:]: F.col(name) / n for name in every}, "steps": F.coalesce(n, F.lit(0)).cast("bigint")}]

    out = history_columns(df, features.KEY, features.DAY, features.ORDER, features.SEQ_LEN, build, derive=derive)
    return out.drop("_rows", *[c for c in out.columns if c.startswith(("_" + MEAN, "_square_", "_half_"))])


def with_static(df: DataFrame, fitted: styles.Styles) -> DataFrame:
    """The nine static values of feature rows: edges, surface, both styles and their matchup."""
    styled = fitted.add(df)
    faced = asof_join(styled, styled, left_key="opponent", right_key="player", day=features.DAY, number="match_num",
                      values=["player_style_cluster"], prefix="opp_")
    return with_matchup(faced)


def with_matchup(df: DataFrame) -> DataFrame:
    """Static values of rows that have both styles, the opponent's as of the match."""
    opp = F.coalesce("opp_player_style_cluster", F.lit(0))
    full = df.withColumns({"opp_style_cluster": opp, "style_matchup": style_matchup(F.col("player_style_cluster"), opp)})
    return full.withColumns({s: rates.finite_or_zero(F.col(s).cast("double")) for s in features.STATIC_FEATURES})


def _sequence_cells(train: Column) -> list[Column]:
    """Averages over the training rows of the windows' means and mean squares."""
    of = lambda c: F.avg(F.when(train, F.col(c)))
    return [of(MEAN + f).alias("m" + f) for f in features.SEQUENCE_FEATURES] + [of("square_" + f).alias("s" + f) for f in features.SEQUENCE_FEATURES]


def _sequence_scaler(found: dict) -> Scaler:
    """Mean and deviation over all steps of all windows, from the windows' means and mean squares."""
    mean = {MEAN + f: found.get("m" + f) or 0.0 for f in features.SEQUENCE_FEATURES}
    var = {MEAN + f: (found.get("s" + f) or 0.0) - mean[MEAN + f] ** 2 for f in features.SEQUENCE_FEATURES}
    return Scaler(mean, {f: math.sqrt(v) if v > 1e-12 else 1.0 for f, v in var.items()})


# ---- model ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Moments:
    """Class sizes, class means and the variance inside the classes of every scaled value."""

    share: float
    lost: tuple[float, ...]
    won: tuple[float, ...]
    inside: tuple[float, ...]

    def weights(self, shrinkage: float) -> tuple[tuple[float, ...], float]:
        w = tuple((b - a) / (v + shrinkage) if v + shrinkage > 0 else 0.0 for a, b, v in zip(self.lost, self.won, self.inside))
        middle = sum(x * (a + b) / 2 for x, a, b in zip(w, self.lost, self.won))
        odds = math.log(self.share / (1 - self.share)) if 0 < self.share < 1 else 0.0
        return w, odds - middle


@dataclass(frozen=True)
class Model:
    sequence_scaler: Scaler
    static_scaler: Scaler
    styles: styles.Styles
    weights: dict[str, float]
    intercept: float

    def scaled(self, df: DataFrame) -> DataFrame:
        """Window means and static values in the units the model was fitted in."""
        return df.withColumns({**{f: self.sequence_scaler.of(f, F.col(f)) for f in FIELDS},
                               **{s: self.static_scaler.of(s, F.col(s)) for s in features.STATIC_FEATURES}})

    def logit(self) -> Column:
        return _dot([self.weights[n] for n in NAMES], self.intercept)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prob`` to rows whose values are scaled."""
        return df.withColumn("prob", 1 / (1 + F.exp(-self.logit())))


def _dot(weights: Sequence[float], intercept: float) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) * F.lit(w) for n, w in zip(NAMES, weights)], F.lit(intercept))


#: Values per aggregate of ``moments``. A wider one makes a method too long for the JVM to compile.
AT_ONCE = 7


def moments(train: DataFrame, names: Sequence[str] = NAMES) -> Moments:
    """Class sizes, means and variances of the scaled training rows, a few values per pass: a pass
    reads only their columns and brings back two rows."""
    rows: dict[int, dict] = {}
    for at in range(0, len(names), AT_ONCE):
        part = list(enumerate(names))[at:at + AT_ONCE]
        cells = [F.avg(n).alias(f"m{i}") for i, n in part] + [F.var_pop(n).alias(f"v{i}") for i, n in part]
        for r in train.groupBy(F.col("label").cast("int").alias("y")).agg(F.count("*").alias("n"), *cells).collect():
            rows.setdefault(int(r["y"]), {}).update(r.asDict())
    n = {y: rows[y]["n"] if y in rows else 0 for y in (0, 1)}
    mean = {y: tuple(rows[y][f"m{i}"] if y in rows else 0.0 for i in range(len(names))) for y in (0, 1)}
    total = max(1, n[0] + n[1])
    inside = tuple(sum(n[y] * rows[y][f"v{i}"] for y in rows) / total for i in range(len(names)))
    return Moments(n[1] / total, mean[0], mean[1], inside)


@dataclass(frozen=True)
class Fit:
    model: Model
    moments: Moments
    scaled: DataFrame  # all rows of ROW with window means and static values scaled, and split


def fit(history: DataFrame, split: Column, shrinkage: float = SHRINKAGE, label: Column | None = None,
        fitted: styles.Styles | None = None, derive=None, stage=cut_lineage) -> Fit:
    """Model of the rows of split ``train`` with a full window. ``history`` is the feature table;
    ``label`` may stand for its label in the training rows. With ``fitted`` given, ``history`` has the
    styles of both players already and ``derive`` adds the features that are not stored in it.
    ``stage`` stores the rows and gives them back.

    Styles come first and window means last, so that the means are not shuffled. The windows' mean
    squares are only needed for the scaler: they are averaged while the rows are stored.
    """
    marked = history.withColumn("split", split)
    if fitted is None:
        fitted = styles.fit(marked.where("split = 'train'"))
        rows = with_window_means(with_static(marked, fitted))
    else:
        rows = with_window_means(marked, lambda d: with_matchup(derive(d)))
    rows = rows.where(F.col("steps") == features.SEQ_LEN)
    seen = Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("n"), *_sequence_cells(F.col("split") == "train"))
    kept = [c for c in (*ROW, "split") if c in rows.columns]
    table = stage(observed.select(*kept, *FIELDS, *features.STATIC_FEATURES))
    train = table.where("split = 'train'")
    blank = Model(_sequence_scaler(seen.get), fit_static_scaler(train, features.STATIC_FEATURES), fitted, {}, 0.0)
    scaled = blank.scaled(table)
    learned = scaled.where("split = 'train'")
    found = moments(learned if label is None else learned.withColumn("label", label))
    w, b = found.weights(shrinkage)
    model = Model(blank.sequence_scaler, blank.static_scaler, fitted, dict(zip(NAMES, w)), b)
    return Fit(model, found, scaled)


def sweep(fitted: Fit, hold_out: DataFrame, auc, shrinkages: Sequence[float], finer: Sequence[float]) -> list[tuple]:
    """Two-stage search for the shrinkage; all trials of a stage are scored and judged in one job.

    ``auc(df, keys, prob)`` gives a frame of keys and auc.
    """
    def trials(values: Sequence[float], stage: int) -> list[tuple]:
        cells = []
        for v in values:
            w, b = fitted.moments.weights(v)
            cells.append(F.struct(F.lit(float(v)).alias("shrinkage"), F.round(1 / (1 + F.exp(-_dot(w, b))), 9).alias("prob")))
        long = hold_out.select("label", F.inline(F.array(*cells)))
        return [(stage, r["shrinkage"], r["auc"]) for r in auc(long, ["shrinkage"], "prob").collect()]  # one row per trial

    first = trials(shrinkages, 1)
    best = min(first, key=lambda t: (-round(t[2], 9), t[1]))[1]
    return first + trials([best * f for f in finer], 2)


def importance(spark: SparkSession, model: Model) -> DataFrame:
    """Absolute weight per feature with category and display name; time features are left out."""
    rows = [(n.removeprefix(MEAN), n.startswith(MEAN), abs(model.weights[n])) for n in NAMES]
    shown = [r for r in rows if r[0] not in categories.HIDDEN_FEATURES]
    return spark.createDataFrame(shown, "feature string, of_window boolean, importance double").withColumns({
        "category": categories.feature_category(F.col("feature")), "display_name": categories.display_name(F.col("feature"))})


# ---- stored form ---------------------------------------------------------------------------------

_PARAMETER = "part string, position int, feature string, value double"


def parameters(model: Model) -> list[tuple]:
    """The model as rows of (part, position, feature, value)."""
    rows = [("intercept", 0, "", model.intercept)]
    rows += [("weight", i, n, model.weights[n]) for i, n in enumerate(NAMES)]
    for part, scaler in (("sequence", model.sequence_scaler), ("static", model.static_scaler), ("style", model.styles.scaler)):
        rows += [(f"{part}_mean", i, f, v) for i, (f, v) in enumerate(scaler.mean.items())]
        rows += [(f"{part}_std", i, f, v) for i, (f, v) in enumerate(scaler.std.items())]
    rows += [("centre", k, f, v) for k, centre in enumerate(model.styles.centres) for f, v in zip(STYLE_INPUT, centre)]
    return rows


def write_model(spark: SparkSession, model: Model, place: str) -> None:
    spark.createDataFrame(parameters(model), _PARAMETER).coalesce(1).write.parquet(place)


def read_model(spark: SparkSession, place: str) -> Model:
    """The stored model; a table that lacks a part raises ``ValueError``."""
    rows = spark.read.schema(_PARAMETER).parquet(place).orderBy("part", "position").collect()  # a fixed number of rows
    parts: dict[str, dict] = {}
    centres: dict[int, dict] = {}
    for r in rows:
        if r["part"] == "centre":
            centres.setdefault(r["position"], {})[r["feature"]] = r["value"]
        else:
            parts.setdefault(r["part"], {})[r["feature"]] = r["value"]
    missing = {"intercept", "weight", *[f"{p}_{k}" for p in ("sequence", "static", "style") for k in ("mean", "std")]} - set(parts)
    if missing or set(parts["weight"]) != set(NAMES):
        raise ValueError(f"no complete model in {place}: {sorted(missing) or 'weights'}")
    scaler = lambda p: Scaler(parts[f"{p}_mean"], parts[f"{p}_std"])
    ordered = tuple(tuple(centres[k][f] for f in STYLE_INPUT) for k in sorted(centres))
    return Model(scaler("sequence"), scaler("static"), styles.Styles(scaler("style"), ordered), parts["weight"], parts["intercept"][""])
