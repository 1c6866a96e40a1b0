"""Running sums and the like inside an array, and places of pattern matches in a text, in nearly linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256  # an array that grows by one is copied each time, so arrays grow to this size, and then by whole ones


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, where `value` is worked out once however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column], first: Column, kind: str = "int") -> Column:
    """For each value, `step` over all values before it; `step` is associative and `first` changes nothing."""
    none = F.array().cast(f"array<{kind}>")

    def cut(array: Column) -> Column:
        last = F.floor(F.greatest(F.size(array) - 1, F.lit(0)) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(array, c * CHUNK + 1, F.lit(CHUNK)))

    def within(chunk: Column) -> Column:
        def add(state: Column, value: Column) -> Column:
            return F.struct(step(state["at"], value).alias("at"), F.array_append(state["list"], state["at"]).alias("list"))

        return F.aggregate(chunk, F.struct(first.alias("at"), none.alias("list")), add)

    def join(state: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["list"], lambda x: step(state["at"], x))
        return F.struct(step(state["at"], chunk["at"]).alias("at"), F.array_append(state["lists"], moved).alias("lists"))

    empty = F.array().cast(f"array<array<{kind}>>")
    chunks = F.transform(once(values, cut), within)
    return F.flatten(F.aggregate(chunks, F.struct(first.alias("at"), empty.alias("lists")), join, lambda s: s["lists"]))


def placed(value: Column, pattern: str, group: int = 0) -> Column:
    """All matches of `pattern` with their zero-based places, and the gap after the last one.

    An array of (before, whole, counted, at): the text before a match, the match (null after the last gap), its
    `group`, and the code points in front of `before`.
    """
    found = F.regexp_extract_all(value, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.split(value, pattern, -1).alias("before"),
        found.alias("whole"),
        (F.regexp_extract_all(value, F.lit(pattern), F.lit(group)) if group else found).alias("counted"),
    )

    def place(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(p["before"]) + F.coalesce(F.length(p["whole"]), F.lit(0)))
        starts = running(sizes, lambda a, b: a + b, F.lit(0))
        return F.zip_with(
            pieces,
            starts,
            lambda p, at: F.struct(p["before"].alias("before"), p["whole"].alias("whole"), p["counted"].alias("counted"), at.alias("at")),
        )

    return once(parts, place)
