"""Session helpers: a tuned local session for tests/bench and the checkpoint folder rule."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int = 8, app: str = "colscope") -> SparkSession:
    """Session used by tests and the bench.

    On a cluster, the caller's session is used as is; nothing here is required.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, bench) gets a
    private scratch folder; a cluster session without it is an error, since a
    machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="colscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
        return folder
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


#: Intermediate tables of this driver process that have not been dropped yet.
_LIVE: dict[str, SparkSession] = {}
#: Lists that note the paths made on their thread, the innermost call's last.
_NOTED = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark reaches; one that is not there is none."""
    _delete(spark, path)


def scratch_path(spark: SparkSession) -> str:
    """A new path for an intermediate table below the shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/colscope-{uuid.uuid4().hex}"
    _LIVE[path] = spark
    for noted in getattr(_NOTED, "lists", ()):
        noted.append(path)
    return path


def _materialised(df: DataFrame, path: str, rows_per_file: int = 0, compression: str | None = None) -> DataFrame:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(paths: list[str]) -> None:
    for path in paths:
        if (spark := _LIVE.pop(path, None)) is not None:
            _delete(spark, path)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One write job (an eager ``Dataset.checkpoint`` runs a count job and then a
    second job to write); the result has no lineage to recompute, so losing an
    executor later costs nothing.  Spark's cleaner does not know these files:
    ``Scratch`` drops them when their results are consumed, and whatever a
    returned, still unread result needs goes at ``drop_intermediates`` or at the
    end of the driver.
    """
    return _materialised(df, scratch_path(df.sparkSession))


def drop_intermediates() -> None:
    """Delete every intermediate table that is still there; results that read them are gone then."""
    for path, spark in list(_LIVE.items()):
        _LIVE.pop(path, None)
        try:
            _delete(spark, path)
        except Exception as error:  # the session may be stopped already
            if spark.sparkContext._jsc is not None:
                raise error


class Scratch:
    """Intermediate tables of one call: all are deleted at the end of the block.

    ``with Scratch() as tables: t = tables.keep(df)`` materialises ``df``; what
    the call returns must not read such a table any more.  ``tables.result(df)``
    materialises the returned table, which outlives the block.
    """

    def __init__(self) -> None:
        self._paths: list[str] = []

    def __enter__(self) -> "Scratch":
        return self

    def path(self, spark: SparkSession) -> str:
        """A new path that is deleted with the tables."""
        self._paths.append(scratch_path(spark))
        return self._paths[-1]

    def keep(self, df: DataFrame, rows_per_file: int = 0, compression: str | None = None) -> DataFrame:
        """``df`` materialised, in files of at most ``rows_per_file`` rows (0: any number), compressed as the session does it or as asked for."""
        return _materialised(df, self.path(df.sparkSession), rows_per_file, compression)

    def drop(self) -> None:
        _drop(self._paths)
        self._paths = []

    @staticmethod
    def result(df: DataFrame) -> DataFrame:
        return reliable_checkpoint(df)

    def __exit__(self, *_: object) -> None:
        self.drop()


@contextmanager
def _setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_scans(spark: SparkSession, split_bytes: int) -> AbstractContextManager[None]:
    """Inside the block, tasks that read files get at most about ``split_bytes`` each."""
    return _setting(spark, "spark.sql.files.maxPartitionBytes", split_bytes)


def brief_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside the block, a query's shuffle files are deleted when it ends, instead of when the driver's garbage collector sees them."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` returns, materialised; every intermediate table that this thread made for it is deleted."""
    lists = _NOTED.__dict__.setdefault("lists", [])
    made: list[str] = []
    lists.append(made)
    try:
        unsettled = build()
    finally:
        lists.pop()
    out = reliable_checkpoint(unsettled)
    _drop(made)
    return out


atexit.register(drop_intermediates)
