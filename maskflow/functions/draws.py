"""Keyed draws: random-looking values that depend only on a key, a scope and the input value.

A draw is the same wherever and however often a task runs, so equal inputs get equal replacements
without collecting distinct values, and a lost executor changes nothing. One SHA-256 digest (64 hex
digits) yields four independent draws of 60 bits.
"""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskflow.functions.stage import Stage

DRAW_RANGE = 2.0**60
DRAWS_PER_DIGEST = 4
_HEX_PER_DRAW = 15


def fresh_key() -> str:
    """A key for one run; outputs of two runs with different keys cannot be linked."""
    return secrets.token_hex(16)


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def digest(key: str, scope: str, *values: Column) -> Column:
    parts: list[Column] = [F.lit(f"{key}|{scope}|")]
    for position, value in enumerate(values):
        if position:
            parts.append(F.lit("|"))
        parts.append(text(value))
    return F.sha2(F.concat(*parts), 256)


def draw(dg: Column, index: int = 0) -> Column:
    """The `index`-th integer in [0, 2^60) of a digest."""
    if not 0 <= index < DRAWS_PER_DIGEST:
        raise ValueError("a digest holds four draws")
    return F.conv(F.substring(dg, 1 + _HEX_PER_DRAW * index, _HEX_PER_DRAW), 16, 10).cast("bigint")


def below(dg: Column, n: int | Column, index: int = 0) -> Column:
    """An integer in [0, n)."""
    return draw(dg, index) % (F.lit(n).cast("bigint") if isinstance(n, int) else n)


def unit(dg: Column, index: int = 0) -> Column:
    """A double in (0, 1)."""
    return (draw(dg, index).cast("double") + F.lit(0.5)) / F.lit(DRAW_RANGE)


def standard_normal(dg: Column, first: int = 0, second: int = 1) -> Column:
    """Box-Muller from two draws of one digest."""
    radius = F.sqrt(F.lit(-2.0) * F.log(unit(dg, first)))
    return radius * F.cos(F.lit(2.0 * math.pi) * unit(dg, second))


def one_of(items: list, dg: Column, index: int = 0) -> Column:
    """A uniform choice from a short literal list."""
    if len(items) == 1:
        return F.lit(items[0])
    return F.element_at(F.array(*[F.lit(i) for i in items]), (below(dg, len(items), index) + 1).cast("int"))


def weighted_choice(stage: Stage, items: list, weights: list[float] | None, dg: Column, index: int = 0) -> Column:
    """A choice from a short literal list with relative weights."""
    if not weights:
        return one_of(items, dg, index)
    if len(weights) != len(items):
        raise ValueError("weights must have one entry per list item")
    total = float(sum(weights))
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must not be negative and must not all be zero")
    u = stage.keep(unit(dg, index))
    chosen, reached = None, 0.0
    for item, weight in list(zip(items, weights))[:-1]:
        reached += weight
        condition = u < F.lit(reached / total)
        chosen = F.when(condition, F.lit(item)) if chosen is None else chosen.when(condition, F.lit(item))
    return F.lit(items[-1]) if chosen is None else chosen.otherwise(F.lit(items[-1]))


def random_digits(key: str, scope: str, count: int, *values: Column) -> Column:
    """A text of `count` independent digits."""
    chunks = []
    for start in range(0, count, 15):
        width = min(15, count - start)
        part, index = divmod(start // 15, DRAWS_PER_DIGEST)
        dg = digest(key, scope if part == 0 else f"{scope}#{part}", *values)
        chunks.append(F.lpad(below(dg, 10**width, index).cast("string"), width, "0"))
    return F.concat(*chunks) if chunks else F.lit("")
