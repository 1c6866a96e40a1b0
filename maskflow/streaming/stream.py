"""Mask a stream with the masks that look at one row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from maskflow.plans.mask import mask_table, needs_whole_table
from maskflow.sources.lookups import Lookups


def mask_stream(
    df: DataFrame, config: dict, key: str, lookups: Lookups | None = None, row_key: list[str] | None = None
) -> DataFrame:
    """The masked stream. The key must be given: a restarted query has to mask as before."""
    whole = needs_whole_table(config)
    if whole:
        raise ValueError(f"these columns need the whole table first and cannot be masked in a stream: {whole}")
    return mask_table(df, config, lookups, key, row_key)
