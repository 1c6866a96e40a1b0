"""Numeric helpers: whole numbers from text, Swiss social-security style numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskflow.functions.stage import Stage


# Decimal numbers as text; the JVM would also read `1d`, `2f` and hexadecimal.
NUMBER_SHAPE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(value: Column) -> Column:
    """A number from text; the shape is tested first, since a failed cast is slow."""
    shown = F.trim(value.cast("string"))
    return F.when(shown.rlike(NUMBER_SHAPE), shown.try_cast("double"))


def to_whole(value: Column) -> Column:
    """A bigint from text such as `7`, `12.0` or `1e3`; null for anything else."""
    number = to_double(value)
    whole = F.when((number == F.floor(number)) & (F.abs(number) < F.lit(9.2e18)), number.try_cast("bigint"))
    digits = value.cast("string").rlike(r"^\s*[+-]?[0-9]{1,18}\s*$")
    return F.when(digits, F.trim(value.cast("string")).try_cast("bigint")).otherwise(whole)


def social_security_number(stage: Stage, draw: Column) -> Column:
    """`756.dddd.dddd.cc`; digits weigh 1 and 3 in turn, 28 is the sum for the fixed 756."""
    identifier = stage.keep(draw % F.lit(10**8).cast("bigint"))
    total: Column = F.lit(28).cast("bigint")
    for place in range(8):
        digit = F.floor(identifier / F.lit(float(10 ** (7 - place)))) % 10
        total = total + digit * (3 if place % 2 == 0 else 1)
    remainder, shown = stage.keep_all([total % 11, F.lpad(identifier.cast("string"), 8, "0")])
    check = F.when(remainder < 2, F.lit(0)).otherwise(F.lit(11) - remainder)
    return F.concat(
        F.lit("756."),
        F.substring(shown, 1, 4),
        F.lit("."),
        F.substring(shown, 5, 4),
        F.lit(".0"),
        check.cast("string"),
    )
