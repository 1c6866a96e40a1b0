"""Generate a synthetic table by configuration."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.functions.draws import fresh_key
from maskflow.functions.names import column as named
from maskflow.functions.stage import Stage
from maskflow.operators.generators import GENERATORS, GenerateContext, with_nulls
from maskflow.sources.lookups import Lookups

DEFAULT_ROWS = 1000
ROW_ID = "__row"


def generate_table(
    spark: SparkSession,
    config: dict,
    lookups: Lookups | None = None,
    key: str | None = None,
    ids: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """The table that `config` describes, columns in configuration order.

    Later columns may read earlier ones. Row ids are `0 .. rows - 1`; `ids`, a frame with such ids in its
    only column, extends an existing table instead, and its ids are kept as the first column.
    """
    count = rows if rows is not None else int(config.get("rows", DEFAULT_ROWS))
    if ids is None:
        base, last_id = spark.range(count).withColumnRenamed("id", ROW_ID), count - 1
        kept: list[str] = []
    else:
        kept = [ids.columns[0]]
        base = ids.select(named(kept[0]).cast("bigint").alias(ROW_ID))
        if any(s.get("unique") for s in config["columns"].values()):
            _check_dense(base)
        found = base.agg(F.count("*"), F.coalesce(F.max(ROW_ID), F.lit(-1))).first()
        count, last_id = rows if rows is not None else int(found[0]), int(found[1])
    stage = Stage(base)
    ctx = GenerateContext(key or fresh_key(), count, base, ROW_ID, lookups or Lookups(spark), stage, last_id)
    names: list[str] = []
    _check_names([c for c, s in config["columns"].items() if s.get("function") in GENERATORS and s["function"] != "address"])
    for name, settings in config["columns"].items():
        function = settings.get("function")
        if function not in GENERATORS:
            if function:
                warnings.warn(f"{function!r} is not a known function; column {name!r} is left out", stacklevel=2)
            continue
        made = GENERATORS[function](name, settings, ctx)
        for label, value in made.items():
            stage.df = stage.df.withColumn(label, with_nulls(ctx, label, settings, value))
            names.append(label)
    _check_names([*kept, *names])
    return stage.df.select(*[F.col(ROW_ID).alias(k) for k in kept], *[named(n) for n in names])


def _check_dense(ids: DataFrame) -> None:
    """Unique numbers are a permutation of the row ids, so ids that are not exactly 0 .. n - 1 would give repeats."""
    found = ids.agg(F.count("*"), F.count(ROW_ID), F.min(ROW_ID), F.max(ROW_ID), F.count_distinct(ROW_ID)).first()
    n = found[0]
    if n and tuple(found) != (n, n, 0, n - 1, n):
        raise ValueError("unique numbers need ids from 0 to the number of rows less one, each once")


def _check_names(names: list[str]) -> None:
    """Spark does not tell names apart by case, so such a pair would silently be one column."""
    seen: dict[str, str] = {}
    for n in names:
        if n.lower() in seen:
            raise ValueError(f"columns {seen[n.lower()]!r} and {n!r} have the same name")
        seen[n.lower()] = n
