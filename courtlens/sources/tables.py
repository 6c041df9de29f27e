"""Readers and writers of raw matches, processed tables, predictions, parameters and reports."""

from __future__ import annotations

import csv
import uuid
from typing import Callable, Iterable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from courtlens.functions import dates
from courtlens.operators.orient import STATS
from courtlens.session import _checkpoint_dir_ready

_TEXT = ("tourney_id", "tourney_name", "surface", "tourney_level", "round", "score", "winner_name", "loser_name",
         "winner_ioc", "loser_ioc", "winner_hand", "loser_hand")
_NUMBER = ("winner_ht", "loser_ht", "winner_rank", "loser_rank", *[f"{side}_{s}" for side in ("w", "l") for s in STATS])
RAW_SCHEMA = StructType(
    [StructField("tourney_date", IntegerType()), StructField("match_num", LongType())]
    + [StructField(c, StringType()) for c in _TEXT] + [StructField(c, DoubleType()) for c in _NUMBER])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints, which every executor can reach."""
    if not _checkpoint_dir_ready(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


# ---- matches -----------------------------------------------------------------------------------


def read_raw_matches(spark: SparkSession, folder: str, merged: str | None = None) -> DataFrame:
    """Yearly match files including older years by header name; the merged file when there are none.

    Files may lack columns or order them differently, so every file is read by its own header:
    paths are grouped by header and each group is one scan.
    """
    globs = [p for p in (f"{folder}/atp_matches_*.csv", f"{folder}/older_years/atp_matches_*.csv") if _exists(spark, p)]
    if not globs:
        if merged is None or not _exists(spark, merged):
            raise FileNotFoundError(f"No raw match files found in {folder}")
        globs = [merged]
    frames = [_typed(part) for part in _by_header(spark, globs)]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def _by_header(spark: SparkSession, globs: Sequence[str]) -> Iterable[DataFrame]:
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in first_lines(spark, globs).collect():  # one row per file
        groups.setdefault(tuple(next(csv.reader([r["line"]]))), []).append(unquote(r["path"]))
    for header, paths in sorted(groups.items()):
        schema = StructType([StructField(c, StringType()) for c in header])
        yield spark.read.schema(schema).option("header", True).csv(paths)


def first_lines(spark: SparkSession, globs: Sequence[str]) -> DataFrame:
    """(path, line): the first line of every file, by one job over all of them. Files without a
    line are left out."""
    lines = spark.read.text(list(globs)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("id"))
    return lines.where("at = 0").groupBy("path").agg(F.min_by("value", "id").alias("line"))


def _typed(df: DataFrame) -> DataFrame:
    known = {f.name: f.dataType for f in RAW_SCHEMA}
    return df.select(*[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a match table by year of its date."""
    with_year = df.withColumn("year", dates.year_of(F.col("tourney_date")))
    with_year.write.mode("overwrite").partitionBy("year").option("header", True).format(fmt).save(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


# ---- feature cache -----------------------------------------------------------------------------


_MANIFEST = "version bigint, feature_names string, place string"


def _newest_version(spark: SparkSession, path: str):
    """The newest finished version's manifest row, None when there is none."""
    try:
        manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
        return manifest.agg(F.max_by(F.struct("version", "feature_names", "place"), "version").alias("m")).first()["m"]
    except AnalysisException:
        return None


def load_or_build_features(spark: SparkSession, path: str, names: Sequence[str], build: Callable[[], DataFrame],
                           force: bool = False) -> DataFrame:
    """The stored feature table, rebuilt when absent, forced, without names or with other names.

    Every build has a folder of its own, and the manifest row that names it is added last: readers
    see the version before until the new one is whole, and a build that fails changes nothing.
    """
    wanted = ",".join(names)
    stored = _newest_version(spark, path)
    if not force and stored is not None and stored["feature_names"] == wanted:
        return spark.read.parquet(f"{path}/{stored['place']}")
    place = f"rows-{uuid.uuid4().hex}"
    build().write.parquet(f"{path}/{place}")
    version = 1 if stored is None else stored["version"] + 1
    spark.createDataFrame([(version, wanted, place)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/{place}")


# ---- predictions -------------------------------------------------------------------------------


def nested_predictions(df: DataFrame) -> DataFrame:
    """Flat predictions to the nested document form."""
    def person(side: str):
        return F.struct(F.lit("").alias("slug"), F.col(side).alias("name"), F.lit(None).cast("string").alias("country"),
                        F.lit(None).cast("int").alias("last_rank")).alias(side)

    features = F.array().cast("array<struct<feature:string,importance:double,category:string,display_name:string>>")
    return df.select(
        "match_id", "match_num", "tourney_id", "tourney_name", "tourney_level", dates.iso_text(F.col("tourney_date")).alias("date"),
        "round", "surface", person("player_one"), person("player_two"), "actual_winner",
        F.col("raw_probability").alias("raw_probability_player_one"), "raw_logit",
        F.col("prob_one").alias("predicted_probability_player_one"), F.col("prob_two").alias("predicted_probability_player_two"),
        "predicted_winner", features.alias("top_features"), dates.year_of(F.col("tourney_date")).alias("year"))


def write_predictions(df: DataFrame, path: str) -> None:
    """Flat CSV and nested JSON by year."""
    flat = df.select("match_id", "match_num", "player_one", "player_two", "tourney_date", "raw_probability", "prob_one",
                     "raw_logit", "prediction", "actual")
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/flat")
    nested_predictions(df).write.mode("overwrite").partitionBy("year").json(f"{path}/by_year", ignoreNullFields=False)


PREDICTION_SCHEMA = (
    "match_id string, match_num bigint, tourney_id string, tourney_name string, tourney_level string, date string, round string, surface string, "
    "player_one struct<slug:string,name:string,country:string,last_rank:int>, player_two struct<slug:string,name:string,country:string,last_rank:int>, "
    "actual_winner string, raw_probability_player_one double, raw_logit double, predicted_probability_player_one double, "
    "predicted_probability_player_two double, predicted_winner string, "
    "top_features array<struct<feature:string,importance:double,category:string,display_name:string>>, year int")


def read_predictions(spark: SparkSession, path: str, year: int) -> DataFrame | None:
    """Nested predictions of one year by partition pruning; None when none are stored."""
    if not _exists(spark, f"{path}/by_year"):
        return None
    return spark.read.schema(PREDICTION_SCHEMA).json(f"{path}/by_year").filter(F.col("year") == year)


def newest_run(spark: SparkSession, pattern: str, fallback: str) -> str:
    """Folder of the newest file matching a pattern, else the fallback: a run writes one folder of files."""
    if not _exists(spark, pattern):
        return fallback
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    return newest.rsplit("/", 1)[0]


# ---- parameters and reports --------------------------------------------------------------------

CALIBRATION_SCHEMA = "method string, temperature double, platt_a double, platt_b double"


def read_calibration(spark: SparkSession, path: str | None) -> dict | None:
    """Calibration parameters; None when missing, unreadable or without a method."""
    if path is None or not _exists(spark, path):
        return None
    row = spark.read.schema(CALIBRATION_SCHEMA).json(path, multiLine=True).first()
    if row is None or row.method is None:
        return None
    return {k: v for k, v in row.asDict().items() if v is not None}


def write_calibration(spark: SparkSession, params: dict, path: str) -> None:
    spark.createDataFrame([params], CALIBRATION_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


SUMMARY_FIELDS = ("strategy", "num_bets_placed", "bets_won", "bets_lost", "win_rate", "final_bankroll", "total_profit",
                  "roi_pct", "max_drawdown", "risk_adjusted_roi", "pct_bet_on")


def export_reports(summaries: DataFrame, temperatures: DataFrame, equity: DataFrame, path: str) -> None:
    """Backtest summary, temperature comparison and equity curve as JSON, and as tables to read back."""
    extra = [c for c in ("season", "num_total_matches") if c in summaries.columns]
    summaries.select(*extra, *SUMMARY_FIELDS).write.mode("overwrite").json(f"{path}/summary")
    temperatures.write.mode("overwrite").json(f"{path}/temperatures")
    equity.write.mode("overwrite").json(f"{path}/equity", compression="gzip")  # a row for every bet


SUMMARY_SCHEMA = ("season int, num_total_matches bigint, strategy string, num_bets_placed bigint, bets_won bigint, bets_lost bigint, "
                  "win_rate double, final_bankroll double, total_profit double, roi_pct double, max_drawdown double, "
                  "risk_adjusted_roi double, pct_bet_on double")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).json(f"{path}/summary")


TEMPERATURE_SCHEMA = "season int, temperature double, bets bigint, profit double, hit_rate double, avg_edge double, max_drawdown double, roi double"
EQUITY_SCHEMA = "season int, strategy string, temperature double, bet_number bigint, bankroll double"


def read_temperatures(spark: SparkSession, path: str) -> DataFrame:
    """The saved temperature comparison; fields that a file lacks are null."""
    return spark.read.schema(TEMPERATURE_SCHEMA).json(f"{path}/temperatures")


def read_equity(spark: SparkSession, path: str) -> DataFrame:
    """The saved equity curves, bet by bet."""
    return spark.read.schema(EQUITY_SCHEMA).json(f"{path}/equity")


def save_scaler(spark: SparkSession, scaler, path: str) -> None:
    scaler.to_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str):
    from courtlens.plans.scoring import Scaler
    return Scaler.from_frame(spark.read.parquet(path))
