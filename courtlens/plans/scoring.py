"""Fitted steps: scalers, style clusters, the probability model and its calibration.

Fitting reads the table in Spark and brings back a handful of numbers; applying is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtlens.functions import calibrate, categories, rates
from courtlens.operators.evaluate import auc_by
from courtlens.plans.features import ROLLED
from courtlens.session import cut_lineage
from courtlens.sources.tables import shared_folder

STYLE_INPUT = tuple(f"{r}_roll30" for r in (
    "player_ace_rate", "player_df_rate", "player_1st_win_pct", "player_2nd_win_pct",
    "player_1st_return_win_pct", "player_2nd_return_win_pct"))
assert set(STYLE_INPUT) == {f"{r}_roll30" for r in ROLLED}
STYLES = 4
SEED = 42


# ---- scalers -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per feature; a zero deviation counts as one."""

    mean: dict[str, float]
    std: dict[str, float]

    @property
    def features(self) -> list[str]:
        return list(self.mean)

    def of(self, name: str, value: Column) -> Column:
        if name not in self.mean:
            return value
        return rates.finite_or_zero((value - F.lit(self.mean[name])) / F.lit(self.std[name]))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, self.mean[f], self.std[f]) for i, f in enumerate(self.mean)]
        return spark.createDataFrame(rows, "position int, feature string, mean double, std double")

    @staticmethod
    def from_frame(df: DataFrame) -> "Scaler":
        rows = df.orderBy("position").collect()  # one row per feature
        return Scaler({r.feature: r.mean for r in rows}, {r.feature: r.std for r in rows})


def scaler_stats(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per field with mean and deviation, computed in one pass."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{tag}{i}") for i, c in enumerate(fields)
                   for tag, f in (("m", F.avg), ("s", F.stddev_pop))])
    cells = [F.struct(
        F.lit(i).alias("position"), F.lit(c).alias("feature"), F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.nullif(F.col(f"s{i}"), F.lit(0.0)), F.lit(1.0)).alias("std")) for i, c in enumerate(fields)]
    return row.select(F.inline(F.array(*cells)))


def valid_steps(df: DataFrame, sequence: str = "sequence", mask: str = "mask") -> DataFrame:
    """The unmasked steps of all sequences as rows."""
    pairs = F.arrays_zip(F.col(sequence).alias("s"), F.col(mask).alias("m"))
    return df.select(F.explode(F.filter(pairs, lambda x: x.m > 0)).alias("x")).select("x.s.*")


def fit_sequence_scaler(df: DataFrame, fields: Sequence[str], unscaled: Sequence[str] = ()) -> Scaler:
    return Scaler.from_frame(scaler_stats(valid_steps(df), [f for f in fields if f not in unscaled]))


def fit_static_scaler(df: DataFrame, fields: Sequence[str]) -> Scaler:
    return Scaler.from_frame(scaler_stats(df, fields))


def scale_sequence(sequence: Column, mask: Column, scaler: Scaler, fields: Sequence[str]) -> Column:
    """Scale valid steps, leave padding at zero."""
    def one(x: Column, m: Column) -> Column:
        return F.struct(*[
            F.when(m > 0, scaler.of(f, x.getField(f))).otherwise(x.getField(f)).alias(f) for f in fields])

    return F.zip_with(sequence, mask, one)


def scale_static(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({f: scaler.of(f, F.col(f).cast("double")) for f in scaler.features})


# ---- style clusters ----------------------------------------------------------------------------


def with_style(df: DataFrame, train: Column) -> DataFrame:
    """Style cluster 0..3 from the long-run rates; fitted on the training rows, given to all.

    Cluster numbers follow the order of the centres' serve strength, so they do not depend on
    the random start. Without training rows everyone is in cluster 0.
    """
    filled = df.withColumns({f"_z_{c}": F.coalesce(c, F.lit(0.0)) for c in STYLE_INPUT})
    inputs = [f"_z_{c}" for c in STYLE_INPUT]
    training = filled.filter(train)
    if training.isEmpty():
        return df.withColumn("player_style_cluster", F.lit(0))
    scaler = fit_static_scaler(training, inputs)
    vector = array_to_vector(F.array(*[scaler.of(c, F.col(c)) for c in inputs]))
    ready = filled.withColumn("_style", vector)
    model = KMeans(k=STYLES, seed=SEED, featuresCol="_style", predictionCol="_cluster").fit(
        ready.filter(train).select("_style"))
    centres = [tuple(c) for c in model.clusterCenters()]
    order = sorted(range(len(centres)), key=lambda i: (sum(centres[i][2:4]), centres[i]))
    new_number = F.create_map(*[F.lit(v) for new, old in enumerate(order) for v in (old, new)])
    return model.transform(ready).withColumn("player_style_cluster", new_number[F.col("_cluster")]).drop(
        "_style", "_cluster", *inputs)


def style_matchup(player: Column, opponent: Column) -> Column:
    return player * 10 + opponent


# ---- probability model -------------------------------------------------------------------------


def flat_vector(sequence: Column, fields: Sequence[str], static: Sequence[str]) -> Column:
    """Sequence steps and static values as one vector."""
    steps = F.flatten(F.transform(sequence, lambda x: F.array(*[x.getField(f) for f in fields])))
    return array_to_vector(F.concat(steps, F.array(*[F.col(s).cast("double") for s in static])))


@dataclass(frozen=True)
class Model:
    logistic: object
    fields: tuple[str, ...]
    static: tuple[str, ...]

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prob``, the player's probability to win."""
        ready = df.withColumn("_x", flat_vector(F.col("sequence"), self.fields, self.static))
        out = self.logistic.transform(ready)
        return out.withColumn("prob", vector_to_array("probability")[1]).drop(
            "_x", "rawPrediction", "probability", "prediction")


def _flat(df: DataFrame, fields: Sequence[str], static: Sequence[str]) -> DataFrame:
    return df.select(flat_vector(F.col("sequence"), fields, static).alias("_x"), F.col("label").cast("double").alias("label"))


def fit_model(train: DataFrame, fields: Sequence[str], static: Sequence[str], reg: float = 0.01,
              mix: float = 0.0, rounds: int = 30) -> Model:
    return _fit(_flat(train, fields, static), fields, static, reg, mix, rounds)


def _fit(ready: DataFrame, fields, static, reg: float, mix: float, rounds: int = 30) -> Model:
    lr = LogisticRegression(featuresCol="_x", labelCol="label", regParam=reg, elasticNetParam=mix, maxIter=rounds)
    return Model(lr.fit(ready), tuple(fields), tuple(static))


def sweep(train: DataFrame, hold_out: DataFrame, fields, static, regs=(0.0001, 0.001, 0.01, 0.1), mixes=(0.0, 0.5),
          finer=(0.25, 0.5, 0.75, 2.0, 4.0)) -> DataFrame:
    """Two-stage search: a coarse grid, then a finer one around the best, judged by hold-out AUC.

    Flat vectors of both splits are stored once in the shared folder, and every trial reads those.
    """
    spark = train.sparkSession
    place = shared_folder(spark, "sweep")
    for name, part in (("train", train), ("hold_out", hold_out)):
        _flat(part, fields, static).write.parquet(f"{place}/{name}")
    ready, judged = spark.read.parquet(f"{place}/train"), spark.read.parquet(f"{place}/hold_out")

    def trial(reg, mix, stage):
        fitted = _fit(ready, fields, static, reg, mix).logistic.transform(judged)
        scored = fitted.select("label", vector_to_array("probability")[1].alias("prob"))
        auc = auc_by(scored.withColumn("_all", F.lit(1)), ["_all"], "prob", "label").first()["auc"]
        return stage, float(reg), float(mix), float(auc)

    trials = [trial(r, m, 1) for r in regs for m in mixes]
    _, reg, mix, _ = max(trials, key=lambda t: t[3])
    trials += [trial(reg * f, mix, 2) for f in finer]
    return spark.createDataFrame(trials, "stage int, reg double, mix double, auc double")


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.agg(F.max_by(F.struct("stage", "reg", "mix", "auc"), F.struct("auc", -F.col("reg"))).alias("t")).select("t.*")


def importance(spark: SparkSession, model: Model, steps: int) -> DataFrame:
    """Mean absolute weight per feature over the steps, with category and display name.

    For a linear model the input gradient is the weight itself. Raw and time features are left out.
    """
    weights = [abs(float(w)) for w in model.logistic.coefficients]
    width = len(model.fields)
    rows = [(f, sum(weights[i * width + j] for i in range(steps)) / steps) for j, f in enumerate(model.fields)]
    rows += [(f, weights[steps * width + j]) for j, f in enumerate(model.static)]
    shown = [r for r in rows if not r[0].startswith("raw_") and r[0] not in categories.HIDDEN_FEATURES]
    return spark.createDataFrame(shown, "feature string, importance double").withColumns({
        "category": categories.feature_category(F.col("feature")),
        "display_name": categories.display_name(F.col("feature"))})


def top_features(table: DataFrame, n: int = 20) -> DataFrame:
    return table.orderBy(F.col("importance").desc(), "feature").limit(n)


def importance_shares(table: DataFrame) -> DataFrame:
    """Importance in percent of the total and the largest share per category (a table of features)."""
    total = table.agg(F.sum("importance")).scalar()
    shares = table.withColumn("share", F.col("importance") / total * 100)
    best = shares.groupBy("category").agg(F.max("share").alias("category_max"))
    return shares.join(best, "category")


def shuffled_labels(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Labels swapped inside about half of the matches, the same way for both rows."""
    flip = F.pmod(F.xxhash64("match_id", "match_num", F.lit(seed)), F.lit(2)) == 1
    return df.withColumn("label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))


# ---- calibration -------------------------------------------------------------------------------


def temperature_losses(df: DataFrame, temperatures: Sequence[float], prob: str, actual: str) -> DataFrame:
    """Loss per candidate temperature in one pass; candidates are averaged before the shuffle."""
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    logit = df.select(calibrate.to_logit(F.col(prob)).alias("_l"), F.col(actual).alias("_y"))
    tried = logit.select("*", F.explode(grid).alias("temperature"))
    loss = calibrate.negative_log_likelihood(calibrate.to_probability(F.col("_l") / F.col("temperature")), F.col("_y"))
    return tried.groupBy("temperature").agg(F.avg(loss).alias("nll"))


def fit_temperature(df: DataFrame, prob: str = "raw_probability", actual: str = "actual", max_t: float = 2.5,
                    passes: int = 2, cells: int = 50) -> DataFrame:
    """Temperature in (0, max_t] with the smallest loss: a grid, then finer grids around the best."""
    step = max_t / cells
    df = cut_lineage(df.select(prob, actual))  # read once per pass
    grid = [i * step for i in range(1, cells + 1)]
    best = None
    for _ in range(passes):
        losses = temperature_losses(df, grid, prob, actual)
        best = losses.agg(F.min_by(F.struct("temperature", "nll"), F.struct("nll", "temperature")).alias("b")).select("b.*")
        centre = best.first()["temperature"]
        step = step / (cells / 2)
        grid = [t for t in (centre + i * step for i in range(-cells // 2, cells // 2 + 1)) if 0.01 <= t <= max_t]
    return best


def fit_platt(df: DataFrame, prob: str = "raw_probability", actual: str = "actual") -> tuple[float, float]:
    """Slope in [0.01, 20] and intercept in [-10, 10] on the logit, by unregularised logistic regression."""
    ready = df.select(array_to_vector(F.array(calibrate.to_logit(F.col(prob)))).alias("x"), F.col(actual).cast("double").alias("y"))
    lr = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=0.0, standardization=False, maxIter=200, tol=1e-12,
        lowerBoundsOnCoefficients=Matrices.dense(1, 1, [0.01]), upperBoundsOnCoefficients=Matrices.dense(1, 1, [20.0]),
        lowerBoundsOnIntercepts=Vectors.dense([-10.0]), upperBoundsOnIntercepts=Vectors.dense([10.0]))
    model = lr.fit(ready)
    return float(model.coefficients[0]), float(model.intercept)
