"""Mask a table by configuration.

The configuration is `{"columns": {name: {"data_type": ..., "function": ..., settings}}}`. The whole chain
is one plan: expression masks add no shuffle, lookup masks add broadcast joins, and only `shuffle_codes`,
`random_int` with `unique` and `fill_with_random_distribution` read the table beforehand.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from maskflow.functions.draws import fresh_key
from maskflow.functions.names import column as named
from maskflow.functions.stage import Stage
from maskflow.operators.masks import MASKS, WHOLE_TABLE, MaskContext, masked_digits
from maskflow.sources.lookups import Lookups

STATUS_SCHEMA = "column string, function string, ok boolean, changed long, rejected long"


@dataclass
class MaskPlan:
    """The masked table, and what is needed to report on it."""

    working: DataFrame
    keep: list[tuple[str, Column]]
    masked: dict[str, tuple[str, Column]]
    dropped: list[str]
    unknown: dict[str, str]

    @property
    def frame(self) -> DataFrame:
        return self.working.select(*[c.alias(name) for name, c in self.keep])

    def _counts(self) -> list[Column]:
        counts = []
        for i, (name, (function, out)) in enumerate(self.masked.items()):
            source = named(name)
            changed = ~source.cast("string").eqNullSafe(out.cast("string"))
            rejected = source.isNotNull() & out.isNull()
            if function == "phone_nr":
                rejected = rejected | (F.coalesce(masked_digits(source), F.lit(7)) < 7)
            counts.append(F.count_if(changed).alias(f"c{i}"))
            counts.append(F.count_if(rejected).alias(f"r{i}"))
        return counts

    def status(self) -> DataFrame:
        """One row per configured column: does its function exist, how many rows changed, how many were rejected."""
        spark = self.working.sparkSession
        fixed = self.fixed()
        parts = [spark.createDataFrame(fixed, STATUS_SCHEMA)] if fixed else []
        if self.masked:
            one = self.working.agg(*self._counts())
            rows = F.array(
                *[
                    F.struct(
                        F.lit(name).alias("column"),
                        F.lit(function).alias("function"),
                        F.lit(True).alias("ok"),
                        F.col(f"c{i}").alias("changed"),
                        F.col(f"r{i}").alias("rejected"),
                    )
                    for i, (name, (function, _)) in enumerate(self.masked.items())
                ]
            )
            parts.append(one.select(F.inline(rows)))
        if not parts:
            return spark.createDataFrame([], STATUS_SCHEMA)
        status = parts[0]
        for part in parts[1:]:
            status = status.unionByName(part)
        return status

    def fixed(self) -> list[tuple]:
        """The status of columns that need no count."""
        return [(name, "delete", True, None, None) for name in self.dropped] + [(name, function, False, None, None) for name, function in self.unknown.items()]

    def observed(self) -> tuple[DataFrame, Observation]:
        """The masked table with the same counts taken during its own write, without another pass."""
        observation = Observation("mask_status")
        if not self.masked:
            return self.frame, observation
        return (
            self.working.observe(observation, *self._counts()).select(*[c.alias(name) for name, c in self.keep]),
            observation,
        )


def plan_masks(
    df: DataFrame,
    config: dict,
    lookups: Lookups | None = None,
    key: str | None = None,
    row_key: list[str] | None = None,
) -> MaskPlan:
    """Build the plan; nothing is computed but the sizes of lookups and of the whole-table masks."""
    settings = config["columns"]
    lookups = lookups or Lookups(df.sparkSession)
    present = df.columns
    declared = {
        c for c in present if str(settings.get(c, {}).get("data_type", "")).lower().startswith("int")
    }
    ctx = MaskContext(
        key=key or fresh_key(),
        lookups=lookups,
        source=df,
        stage=Stage(df),
        fields={f.name: f.dataType for f in df.schema.fields},
        whole_number=declared,
        row_key=row_key,
        order=present,
    )
    masked: dict[str, tuple[str, Column]] = {}
    dropped: list[str] = []
    unknown: dict[str, str] = {}
    functions = {c: settings[c]["function"] for c in present if settings.get(c, {}).get("function")}
    for c in settings:
        if settings[c].get("function") == "delete" and c not in present:
            warnings.warn(f"column {c!r} to delete is not in the table", stacklevel=2)
    # E-mail reads final names and a hash reads whatever comes before it, so they are planned last.
    rank = {"email": 1, "hash": 2}
    for c in sorted(functions, key=lambda name: (rank.get(functions[name], 0), present.index(name))):
        function = functions[c]
        if function == "delete":
            dropped.append(c)
        elif function not in MASKS:
            warnings.warn(f"{function!r} is not a known function; column {c!r} is kept", stacklevel=2)
            unknown[c] = function
        else:
            # Kept as a column, since e-mails, hashes and the status read it again.
            out = ctx.stage.keep(MASKS[function](c, settings[c], ctx))
            ctx.outputs[c] = out
            masked[c] = (function, out)
    keep = [(c, ctx.outputs.get(c, named(c))) for c in present if c not in dropped]
    ordered = {c: masked[c] for c in present if c in masked}
    return MaskPlan(ctx.stage.df, keep, ordered, dropped, unknown)


def mask_table(
    df: DataFrame,
    config: dict,
    lookups: Lookups | None = None,
    key: str | None = None,
    row_key: list[str] | None = None,
) -> DataFrame:
    """The masked table. Without `key` every call masks differently; with one, equal inputs agree across tables."""
    return plan_masks(df, config, lookups, key, row_key).frame


def needs_whole_table(config: dict) -> list[str]:
    """Configured columns whose mask cannot run on a stream."""
    return [
        c
        for c, s in config["columns"].items()
        if s.get("function") in WHOLE_TABLE or (s.get("function") == "random_int" and s.get("unique"))
    ]
