"""Session helpers: a local session for tests and one way to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from typing import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes the shuffle files of a query when the query ends, and not when the driver next collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that ``cut_lineage`` wrote inside each ``passing`` or ``cut_from`` that is open.
_open: list[list[str]] = []


def local_session(cores: int | str = 8, app: str = "courtlens", **conf: str) -> SparkSession:
    """A single-machine session, for tests and the bench only."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir_ready(spark: SparkSession) -> bool:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return True
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
        return True
    if context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        return True
    return False


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so later stages reuse it.

    The rows are written as Parquet: compressed, and later stages read only the columns they use,
    where a checkpoint keeps whole rows as they are in memory. The folder is the one the cluster
    names in ``spark.checkpoint.dir``; a private one is made only on a local master. On a cluster
    that names none this raises.
    """
    spark = df.sparkSession
    if not _checkpoint_dir_ready(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(place)
    if _open:
        _open[-1].append(place)
    return spark.read.schema(df.schema).parquet(place)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files."""
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def delete(spark: SparkSession, places: Iterable[str]) -> None:
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside goes at the end: for steps whose result is stored by then."""
    _open.append([])
    try:
        yield
    finally:
        delete(spark, _open.pop())


def cut_from(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``build`` gives, materialised; what it materialised on its way is deleted."""
    _open.append([])
    try:
        table = cut_lineage(build())
        kept = _open[-1].pop()
    finally:
        delete(spark, _open.pop())
    if _open:
        _open[-1].append(kept)
    return table
