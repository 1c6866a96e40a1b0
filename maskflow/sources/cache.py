"""Tables made from source files once, and kept for later jobs.

A version is written to a folder of its own; when it is whole, a small table with its path is written beside it. Only
such paths are read, so a job never sees half a version, whether its writer is still at work or was lost. Jobs that make
the same version at the same time do not disturb each other: afterwards all of them read the one with the smallest path.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.session import file_system

LAYOUT = 1  # of what is kept; another number makes all versions anew


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything."""
    files, shown = file_system(spark, path)
    return bool(files.globStatus(shown))


def files_at(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, length, modificationTime) of the files at a path, or None if there is nothing."""
    if not is_there(spark, path):
        return None
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def fingerprint(files: DataFrame, *more: str) -> str:
    """Changes with the path, length or time of any of the files; they are source files, few of them."""
    shown = F.concat_ws("|", "path", "length", F.col("modificationTime").cast("double").cast("string"))
    listed = F.concat_ws("\n", F.sort_array(F.collect_list(shown)), *[F.lit(m) for m in (str(LAYOUT), *more)])
    return files.agg(F.sha2(listed, 256).substr(1, 32)).first()[0]


def published(spark: SparkSession, folder: str, version: str) -> str | None:
    """The path of a whole version."""
    marks = f"{folder}/published/{version}-*"
    return spark.read.schema("path string").parquet(marks).agg(F.min("path")).first()[0] if is_there(spark, marks) else None


def cached(spark: SparkSession, folder: str, name: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The version of `name` with the fingerprint `mark`; made, written and published if there is none yet."""
    root, version = folder.rstrip("/"), f"{name}-{mark}"
    found = published(spark, root, version)
    if found is None:
        own = f"{version}-{uuid.uuid4().hex}"
        make().write.parquet(f"{root}/data/{own}")
        paths = spark.createDataFrame([(f"{root}/data/{own}",)], "path string")
        paths.coalesce(1).write.parquet(f"{root}/published/{own}")
        found = published(spark, root, version)
    return spark.read.parquet(found)
