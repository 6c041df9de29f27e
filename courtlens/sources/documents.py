"""Nested metric documents: one JSON text per run with a summary and its folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_VALIDATION = "struct<accuracy:double,match_accuracy:double,auc:double,log_loss:double>"
_MEASURES = ("accuracy", "auc", "brier", "log_loss")
_TEST = "struct<" + ",".join(f"{p}{m}:double" for p in ("", "match_") for m in _MEASURES) + ">"
FOLD = f"struct<split:struct<name:string,description:string,val_cutoff:string>,metrics:struct<validation:{_VALIDATION}>>"
SCHEMA = (f"summary struct<val_accuracy_mean:double,val_accuracy_std:double,val_auc_mean:double>, folds array<{FOLD}>")


#: Documents of single runs; which of the fields a run wrote differs from file to file.
RUN_SCHEMA = f"run string, metrics struct<test:{_TEST},validation:{_VALIDATION}>"


def write_metric_documents(folds: DataFrame, runs: DataFrame, path: str) -> None:
    """Two kinds of documents as files: one of all folds with their summary, and one per run.

    ``folds`` has name, description, val_cutoff, accuracy, match_accuracy, auc and log_loss, at most
    one row per season; ``runs`` has run and a struct ``test``. Null fields are not written, so the
    files differ in what they have.
    """
    split = F.struct("name", "description", "val_cutoff").alias("split")
    validation = F.struct("accuracy", "match_accuracy", "auc", "log_loss").alias("validation")
    fold = F.struct(split, F.struct(validation).alias("metrics"))
    best = F.coalesce("match_accuracy", "accuracy")
    summary = F.struct(F.avg(best).alias("val_accuracy_mean"), F.stddev_pop(best).alias("val_accuracy_std"), F.avg("auc").alias("val_auc_mean"))
    document = folds.agg(summary.alias("summary"), F.array_sort(F.collect_list(fold)).alias("folds"))  # one entry per season
    document.coalesce(1).write.json(f"{path}/folds")
    named = runs.select(F.col("run").alias("file"), "run", F.struct("test").alias("metrics"))
    named.repartition("file").write.partitionBy("file").json(f"{path}/runs")


def read_run_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path, multiLine=True)


def test_metrics(documents: DataFrame) -> DataFrame:
    """(run, accuracy, auc, brier, log_loss) of the test section: figures per match where the run
    has its match accuracy, else figures per sample; what is absent counts as 0, as does a missing section."""
    has_match = F.col("metrics.test.match_accuracy").isNotNull()
    return documents.select("run", *[
        F.coalesce(F.when(has_match, F.col(f"metrics.test.match_{m}")).otherwise(F.col(f"metrics.test.{m}")), F.lit(0.0)).alias(m) for m in _MEASURES])


def series(documents: DataFrame) -> DataFrame:
    """(series, label, value): loss and AUC by fold name, accuracy by season."""
    rows = fold_rows(documents)
    cells = [("loss_history", "name", "log_loss"), ("auc_history", "name", "auc"), ("seasonal_stability", "season", "accuracy")]
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("series"), F.col(label).alias("label"), F.col(value).alias("value")) for s, label, value in cells])))


def read_metric_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def fold_documents(metrics: DataFrame) -> DataFrame:
    """One JSON document per fold from a table of yearly metrics."""
    validation = F.struct("accuracy", F.lit(None).cast("double").alias("match_accuracy"), "auc", "log_loss")
    split = F.struct(F.concat(F.lit("season_"), "year").alias("name"), F.col("year").cast("string").alias("description"),
                     F.concat(F.col("year").cast("string"), F.lit("1231")).alias("val_cutoff"))
    fold = F.struct(split.alias("split"), F.struct(validation.alias("validation")).alias("metrics"))
    return metrics.select(F.to_json(F.struct(F.array(fold).alias("folds"))).alias("text"))


def parsed(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.select(F.from_json(column, SCHEMA).alias("d")).select("d.*")


def fold_rows(documents: DataFrame) -> DataFrame:
    """Fold name, season label and metrics; match-level accuracy is preferred where present."""
    folds = documents.select(F.explode("folds").alias("f"))
    v = "f.metrics.validation"
    cutoff = F.col("f.split.val_cutoff")
    return folds.select(
        F.col("f.split.name").alias("name"), F.col("f.split.description").alias("description"),
        F.when(F.length(cutoff) > 0, F.substring(cutoff, 1, 4)).otherwise(F.col("f.split.name")).alias("season"),
        F.coalesce(f"{v}.match_accuracy", f"{v}.accuracy").alias("accuracy"),
        F.col(f"{v}.auc").alias("auc"), F.col(f"{v}.log_loss").alias("log_loss"))
