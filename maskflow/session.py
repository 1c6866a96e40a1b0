"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Lookup sides above this size are joined by shuffle instead of being broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maskflow")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`); a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="maskflow-")
    return _LOCAL_FOLDERS[context.applicationId]


_OWNED: ContextVar[str | None] = ContextVar("owned scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    root = _OWNED.get() or shared_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it knows it."""
    shown = spark._jvm.org.apache.hadoop.fs.Path(path)
    return shown.getFileSystem(spark._jsc.hadoopConfiguration()), shown


@contextmanager
def owned_scratch(spark: SparkSession) -> Iterator[str]:
    """Everything that is put into the scratch folder meanwhile goes to a folder of its own, which is removed at the end,
    also after an error. Frames made meanwhile have to be written before."""
    folder = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _OWNED.set(folder)
    try:
        yield folder
    finally:
        _OWNED.reset(token)
        files, path = file_system(spark, folder)
        files.delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that later jobs do not repeat its work."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
