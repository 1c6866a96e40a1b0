"""Jobs from files to a file: read, mask or generate, write under the configured name, and leave nothing else behind.

The result is written beside its place and moved there when it is whole; what the job put into the scratch folder, such
as the distinct codes of `shuffle_codes`, is removed at its end, also if it fails.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from maskflow.plans.generate import generate_table
from maskflow.plans.mask import STATUS_SCHEMA, plan_masks
from maskflow.plans.spec import check_config
from maskflow.session import file_system, owned_scratch
from maskflow.sources.files import read_csv
from maskflow.sources.lookups import Lookups
from maskflow.sources.sinks import read_config, write_table

COLUMNAR = {".parquet": "parquet", ".json": "json", ".orc": "orc"}


@dataclass(frozen=True)
class Report:
    """Where the result is, and for each configured column: its function, whether that is known, how many rows changed
    and how many were rejected."""

    path: str
    status: tuple[tuple, ...] = ()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.status), STATUS_SCHEMA)


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """A table of any kind that the extension names; CSV cells stay text."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix in COLUMNAR:
        return spark.read.format(COLUMNAR[suffix]).load(path)
    raise ValueError(f"unsupported file extension: {path}")


def _lookups(spark: SparkSession, lookups: Lookups | str | None) -> Lookups:
    return Lookups.from_files(spark, lookups) if isinstance(lookups, str) else lookups or Lookups(spark)


def _target(config: dict, out: str, default: str) -> tuple[str, dict]:
    """The path of the result and how to write it; without a `format` the extension tells."""
    name = PurePosixPath(str(config.get("filename") or default)).name
    suffix = PurePosixPath(name).suffix.lower()
    kind = config.get("format") or COLUMNAR.get(suffix, "csv")
    return f"{out.rstrip('/')}/{name}", {**config, "format": kind}


def _publish(spark: SparkSession, df: DataFrame, path: str, options: dict, overwrite: bool) -> None:
    """Write beside the target, then move there, so that the target is whole whenever it exists."""
    files, target = file_system(spark, path)
    if files.exists(target) and not overwrite:
        raise FileExistsError(path)
    place = PurePosixPath(path)
    staged = path[: -len(place.name)] + f".{place.name}-{uuid.uuid4().hex}"
    source = file_system(spark, staged)[1]
    try:
        write_table(df, staged, options)
        if overwrite:
            files.delete(target, True)
        if not files.rename(source, target):
            raise FileExistsError(path)
    finally:
        files.delete(source, True)


def mask_file(
    spark: SparkSession,
    data: str,
    config: str | dict,
    out: str,
    lookups: Lookups | str | None = None,
    key: str | None = None,
    row_key: list[str] | None = None,
    overwrite: bool = False,
) -> Report:
    """Mask a file, folder or glob by a configuration (or its path) and write it to `out` under the configured name.

    The name is `filename` of the configuration, else that of the data with `_anonymized`. Lookups may be given as their
    folder. The counts of the report are taken while writing.
    """
    with owned_scratch(spark):
        settings = read_config(spark, config) if isinstance(config, str) else config
        source = PurePosixPath(data)
        stem = "data" if "*" in source.name else source.stem
        path, options = _target(settings, out, f"{stem}_anonymized{source.suffix}")
        plan = plan_masks(read_data(spark, data), settings, _lookups(spark, lookups), key, row_key)
        masked, observation = plan.observed()
        _publish(spark, masked, path, options, overwrite)
        counts = observation.get if plan.masked else {}
        counted = [(name, function, True, counts[f"c{i}"], counts[f"r{i}"]) for i, (name, (function, _)) in enumerate(plan.masked.items())]
        return Report(path, (*plan.fixed(), *counted))


def generate_file(
    spark: SparkSession,
    config: str | dict,
    out: str,
    lookups: Lookups | str | None = None,
    key: str | None = None,
    overwrite: bool = False,
) -> Report:
    """Generate the table of a configuration (or its path) and write it to `out` under its `filename`."""
    with owned_scratch(spark):
        settings = read_config(spark, config) if isinstance(config, str) else config
        if wrong := check_config(settings):
            raise ValueError("; ".join(map(str, wrong)))
        path, options = _target(settings, out, "generated.csv")
        _publish(spark, generate_table(spark, settings, _lookups(spark, lookups), key), path, options, overwrite)
        return Report(path)
