"""A frame that grows by helper columns.

An expression that is used several times is written as a column first. Spark keeps such a column in a
projection of its own, so a digest or a regular expression runs once per row however often it is read;
columns that are read once are merged back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "__stage_"


class Stage:
    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self._made = 0

    def name(self) -> str:
        self._made += 1
        return f"{PREFIX}{self._made}"

    def keep(self, expression: Column) -> Column:
        name = self.name()
        self.df = self.df.withColumn(name, expression)
        return F.col(name)

    def keep_all(self, expressions: list[Column]) -> list[Column]:
        """Several columns that do not read one another, in one projection."""
        names = [self.name() for _ in expressions]
        self.df = self.df.withColumns(dict(zip(names, expressions)))
        return [F.col(n) for n in names]
