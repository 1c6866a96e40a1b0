"""Suggest a mask configuration for a table."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.operators.profile import detect_types

# Column names that tell a column's content.
LAST_NAME_COLUMNS = ["name", "nachname", "nach_name", "last_name"]
FIRST_NAME_COLUMNS = ["vorname", "vor_name", "first_name"]
STREET_COLUMNS = ["strasse"]
HOUSE_NUMBER_COLUMNS = ["hnr", "hausnummer"]

# Settings suggested per function, and the options of a suggested configuration.
SETTINGS = {
    "last_name": {"source": "ogd-bs", "percent_null": 0},
    "first_name": {"source": "ogd-bs", "percent_null": 0},
    "street_name": {"source": "ogd-bs", "location_field": "<location field>", "percent_null": 0},
    "house_number": {"min": 1, "max": 100, "pct_with_suffix": 2, "suffixes": ["a", "b", "c", "d"]},
    "random_int": {"min": 100, "max": 200},
    "random_float": {"digits": 2, "min": 100, "max": 200},
    "list_string": {"list": ["j", "n"]},
}
ROWS_WHEN_EMPTY = 1000


def suggested_function(name: Column, kind: Column) -> Column:
    """By column name first, then by type; null where nothing is suggested."""
    lowered = F.lower(name)
    return (
        F.when(lowered.isin(LAST_NAME_COLUMNS), F.lit("last_name"))
        .when(lowered.isin(FIRST_NAME_COLUMNS), F.lit("first_name"))
        .when(lowered.isin(STREET_COLUMNS), F.lit("street_name"))
        .when(lowered.isin(HOUSE_NUMBER_COLUMNS), F.lit("house_number"))
        .when(kind == "integer", F.lit("random_int"))
        .when(kind == "float", F.lit("random_float"))
        .when(kind == "boolean", F.lit("list_string"))
    )


def suggest_functions(df: DataFrame) -> DataFrame:
    """One row per column: position, column, type, filled, rows, function, settings as JSON."""
    settings: Column = F.lit("{}")
    typed = detect_types(df).withColumn("function", suggested_function(F.col("column"), F.col("type")))
    for function, values in SETTINGS.items():
        settings = F.when(F.col("function") == function, F.lit(json.dumps(values))).otherwise(settings)
    return typed.withColumn("settings", settings)


def suggest_config(df: DataFrame, filename: str = "output.csv") -> dict:
    """The suggested configuration; only one row per column comes to the driver."""
    path = PurePosixPath(filename)
    rows = suggest_functions(df).orderBy("position").collect()
    total = int(rows[0]["rows"]) if rows else 0
    columns = {}
    for r in rows:
        columns[r["column"]] = {"data_type": r["type"], "function": r["function"], **json.loads(r["settings"])}
    return {
        "filename": str(path.with_stem(path.stem + "_anonymized")),
        "format": path.suffix.lower(),
        "separator": ";",
        "encoding": "utf-8",
        "rows": total or ROWS_WHEN_EMPTY,
        "columns": columns,
    }
