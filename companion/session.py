"""Session helpers: the shared checkpoint folder and a local session builder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder, setting one only for local runs.

    The folder comes from the session (``SparkContext.getCheckpointDir`` or
    ``spark.checkpoint.dir``).  Only a single-process ``local`` master without
    either gets a fresh temporary folder; elsewhere (``local-cluster`` too, whose
    executors are processes of their own) an unset folder is an error, because a
    machine-local path would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="companion-ckpt-"))
    return sc.getCheckpointDir()


_RUNS: list[str] = []          # folders of the open runs, innermost last


def _tables(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table path inside the shared checkpoint folder, in the folder of
    the innermost open run (see ``run_tables``) or of the application."""
    return os.path.join(_RUNS[-1] if _RUNS else _tables(spark), f"{name}-{uuid.uuid4().hex}")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop)


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under ``path``, which may be a pattern (as in reads)."""
    fs, hadoop = _file_system(spark, path)
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(hadoop) or [])


def _remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


@contextmanager
def run_tables(spark: SparkSession) -> Iterator[str]:
    """Stage tables written inside the block belong to one run and are removed when it
    ends.  Results are lazy reads of them: write or collect what is to stay first."""
    folder = os.path.join(_tables(spark), f"run-{uuid.uuid4().hex}")
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        _remove(spark, folder)


@contextmanager
def steps_removed(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Stage tables written inside the block are steps towards a result and are removed when it
    ends.  ``keep(df, name)``, which it gives, writes the result, as ``materialize`` would outside."""
    folder = _RUNS[-1] if _RUNS else _tables(spark)
    with run_tables(spark):
        yield lambda df, name: _written(df, name, os.path.join(folder, f"{name}-{uuid.uuid4().hex}"))


def clear_tables(spark: SparkSession) -> None:
    """Remove every stage table that this application has written outside of runs."""
    _remove(spark, _tables(spark))


# Written bytes from which a stage table is not broadcast.  Spark compares a table's file size
# with its threshold, but ids and flags take 10 to 25 times that as a hash table in the driver.
BROADCAST_BYTES = 1 << 19
_WATCHERS: list[list[tuple[str, str]]] = []


@contextmanager
def watched_plans() -> Iterator[list[tuple[str, str]]]:
    """Collect (name, physical plan) of every stage table written inside the block: what
    ``explain`` of a staged result no longer shows."""
    plans: list[tuple[str, str]] = []
    _WATCHERS.append(plans)
    try:
        yield plans
    finally:
        _WATCHERS.remove(plans)


# Shuffled bytes from which adaptive execution joins no more partitions into one, where the
# session names none.  Rows take about ten times that in a sort: Spark's 64 MB spill.
PARTITION_BYTES = 1 << 24
_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


# Whether Spark removes the shuffle files of a query when it ends, not when its driver has
# collected the garbage that refers to them (which may be never: a driver has little of it).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for the block, unless the session has one of its own."""
    if name in spark.conf.getAll:
        yield
        return
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name)


def bounded_partitions(spark: SparkSession):
    """Jobs inside the block sort and hash partitions of ``PARTITION_BYTES``, however large their
    tables are, unless the session sets a size of its own."""
    return _setting(spark, _ADVISED, str(PARTITION_BYTES))


def shuffles_removed(spark: SparkSession):
    """Writes inside the block leave no shuffle files: a written table never needs them again."""
    return _setting(spark, _CLEANUP, "true")


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and cached blocks that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared checkpoint folder
    and continue from the written table (with one folder per value of ``partition_by``).

    This cuts the lineage: later plans start at a scan (short to analyse,
    no recomputation of upstream stages), and a lost executor costs a
    re-read, not a recomputation from the raw inputs.  Tables of ``BROADCAST_BYTES`` or more
    are joined by sorting, never sent through the driver."""
    return _written(df, name, scratch_path(df.sparkSession, name), partition_by)


def _written(df: DataFrame, name: str, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    spark = df.sparkSession
    for plans in _WATCHERS:
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
    with shuffles_removed(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path) if partition_by else spark.read.parquet(path)
    return table.hint("merge") if total_bytes(spark, path) >= BROADCAST_BYTES else table


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "companion") -> SparkSession:
    """Local session used by tests and the bench (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark
