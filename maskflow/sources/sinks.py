"""Writing tables and configurations."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, config: dict | None = None, mode: str = "error") -> None:
    """Write by the `format`, `separator` and `encoding` of a configuration; parquet, CSV or JSON."""
    options = config or {}
    kind = str(options.get("format", "csv")).lower().lstrip(".")
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).option("sep", options.get("separator", ",")).option(
            "encoding", options.get("encoding", "utf-8")
        ).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif kind in ("parquet", "json", "orc"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"unsupported format {kind!r}")


def config_path(path: str) -> str:
    """Where the configuration of an input file goes: beside it, with the suffix `.json`."""
    return str(PurePosixPath(path).with_suffix(".json"))


def write_config(spark: SparkSession, config: dict, path: str, mode: str = "overwrite") -> None:
    """The configuration as indented JSON text; on any file system that Spark can write to."""
    shown = json.dumps(config, ensure_ascii=False, indent=2)
    spark.createDataFrame([(shown,)], "value string").coalesce(1).write.mode(mode).text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration written by `write_config`, or any single JSON file."""
    row = spark.read.text(path, wholetext=True).first()
    return json.loads(row["value"])
