"""Dates and timestamps as values or as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskflow.functions.stage import Stage

# The text form of a timestamp and of a date.
TIMESTAMP_TEXT = "yyyy-MM-dd'T'HH:mm:ss"
DATE_TEXT = "yyyy-MM-dd"
_TIMESTAMP_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"
_DATE_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def add_days(stage: Stage, value: Column, days: Column, kind: T.DataType) -> Column:
    """Shift by whole days and keep the type, the text form and the time of day."""
    if isinstance(kind, T.DateType):
        return F.date_add(value, days.cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # Seconds in UTC would change the wall clock over a clock change; calendar days do not.
        return F.timestamp_add("DAY", days.cast("int"), value)
    # Text has no zone: parse and print without one.
    shown, days = stage.keep_all([value.cast("string"), days.cast("int")])
    stamp = F.when(shown.rlike(_TIMESTAMP_SHAPE), shown.try_cast("timestamp_ntz"))
    day = F.when(shown.rlike(_DATE_SHAPE), shown.try_cast("date"))
    shifted_stamp = F.date_format(F.timestamp_add("DAY", days, stamp), TIMESTAMP_TEXT)
    return F.coalesce(shifted_stamp, F.date_format(F.date_add(day, days), DATE_TEXT))


def day_text(start: str, offset: Column) -> Column:
    return F.date_format(F.date_add(F.lit(start).cast("date"), offset.cast("int")), DATE_TEXT)
