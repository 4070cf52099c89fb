"""Session helpers: a local test session and the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cuestrata")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables staged by the operators that ``settled`` runs, while it does.
_made: ContextVar[list | None] = ContextVar("made", default=None)
#: Whether shuffle files go as soon as the job that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs that run inside."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the files.

    For narrow tables that several branches of a plan read: they are computed once, keep
    their columns and statistics, and survive the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    # shuffle files would stay until the driver collects its garbage
    with with_settings(spark, {CLEANUP: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


def settled(build: Callable[[], DataFrame], name: str = "settled") -> DataFrame:
    """Stage what ``build`` gives and delete the tables that it staged on its way."""
    token = _made.set([])
    try:
        rows = build()
        passing = list(_made.get())
        out = stage(rows, name)
    finally:
        _made.reset(token)
    if _made.get() is not None:
        _made.get().append(out)
    forget(*passing)
    return out


def forget(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: How a write of very many small files puts them in place: by its tasks, and in a local file system (no other is touched)
#: without checksum files and without a ``chmod`` process for each, of which Hadoop starts three a file.
MANY_FILES = {
    "mapreduce.fileoutputcommitter.algorithm.version": "2",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_folders(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write text rows that are sorted by ``keys`` as one folder per key; folders of these keys are replaced, all others kept.

    Below a new path there is nothing to replace, and each task puts its own folders in place.  Below one that is in use
    the driver exchanges folder after folder once all are written.
    """
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    used = fs.exists(where) and fs.listStatusIterator(where).hasNext()
    out = rows.write.partitionBy(*keys).options(**MANY_FILES)
    with with_settings(spark, {CLEANUP: "true"}):
        if used:
            out.option("partitionOverwriteMode", "dynamic").mode("overwrite").text(path)
        else:
            out.mode("append").text(path)
