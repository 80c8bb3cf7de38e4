"""Session helpers: tuned defaults for tests and the shared folder for written tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


FEW_ROWS = 1 << 15  # Rows of a few numbers that may be broadcast, a few MB.

#: Folders written in the innermost ``scratch``, if there is one.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_written", default=None)


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("forcemap")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on for right results: epoch arithmetic is in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shuffles_dropped(spark: SparkSession) -> SparkSession:
    """Have each query's shuffle files removed when it ends: jobs of many written steps never read them again."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="forcemap-")
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under this application's part of the shared folder."""
    return f"{shared_dir(spark)}/forcemap-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For derived inputs that several branches of one plan read: computed once, survives executor
    loss, and the read side knows its real size.
    """
    path = fresh_path(df.sparkSession, label)
    if (folders := _written.get()) is not None:
        folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``staged`` writes inside are removed at the end, but those that a table given to what this yields reads.

    What is kept belongs to the ``scratch`` around this one, if there is one. Nothing that leaves may still read a removed table.
    """
    outer, own, kept = _written.get(), [], []

    def keep(table: DataFrame) -> DataFrame:
        files = table.inputFiles()
        kept.extend(path for path in own if any(f"/{path.rpartition('/')[2]}/" in file for file in files))
        return table

    mark = _written.set(own)
    try:
        yield keep
    finally:
        _written.reset(mark)
        if outer is not None:
            outer += kept
        for path in set(own) - set(kept):
            _remove(spark, path)


def removed(table: DataFrame) -> None:
    """Remove what ``table``, one or several tables of ``staged``, reads, before their ``scratch`` ends."""
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        _remove(table.sparkSession, folder)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for a join that moves both sides by key and broadcasts neither.

    For sides that grow with the input: Spark takes an exploded table, and a written one whose columns compress well, for
    far smaller than it is, and would gather it in the driver. Where it is known that the smaller side has at most ``rows``
    rows of a few numbers, and these are few, the choice is left to Spark.
    """
    return df if rows is not None and rows <= FEW_ROWS else df.hint("merge")
