"""A keyed permutation of the integers [0, n).

A number is split into two digits of mixed radix, and in turn each digit is shifted by a function of the other (a
Feistel network over a x b, after Black and Rogaway 2002). The radices are chosen so that a * b exceeds n by little or
nothing; a number that lands beyond n is permuted again until it is below. How often that can happen at most is found
beforehand from the few numbers beyond n, so the plan has as many steps as it needs and no loop. Unique random integers
need neither a sort nor a shuffle nor a table of used values.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskflow.functions.stage import Stage

# Two primes below 2^31: products of their remainders fit a long, and going from one to the other is not linear.
FIRST, SECOND = 2_147_483_647, 2_147_483_629
TURNS = 5  # a turn shifts both digits
TRIED = 1000  # radices looked at


@dataclass(frozen=True)
class Network:
    """Radices of the high and low digit, four constants for each shift, and how often a number is permuted again."""

    a: int
    b: int
    shifts: tuple[tuple[int, int, int, int], ...]
    again: int


def _radices(n: int) -> tuple[int, int]:
    root = max(1, math.isqrt(max(0, n - 1)) + 1)
    if root >= SECOND:
        raise ValueError(f"no permutation of more than {SECOND}^2 integers")
    found = [(a, -(-n // a)) for a in range(root, root + min(TRIED, root // 2) + 1)]
    # With a single low digit the network would only rotate.
    return min([ab for ab in found if ab[1] > 1] or found, key=lambda ab: (ab[0] * ab[1], ab[0]))


def _shift(x: np.ndarray, c: tuple[int, int, int, int], radix: int) -> np.ndarray:
    return (((x * c[0] + c[1]) % FIRST) * c[2] + c[3]) % SECOND % radix


def _turned(x: np.ndarray, net: Network) -> np.ndarray:
    high, low = x // net.b, x % net.b
    for i in range(0, 2 * TURNS, 2):
        high = (high + _shift(low, net.shifts[i], net.a)) % net.a
        low = (low + _shift(high, net.shifts[i + 1], net.b)) % net.b
    return high * net.b + low


def network(key: str, scope: str, n: int) -> Network:
    shifts = []
    for i in range(2 * TURNS):
        h = hashlib.sha256(f"{key}|{scope}|shift{i}".encode()).hexdigest()
        words = [int(h[k : k + 15], 16) for k in range(0, 60, 15)]
        shifts.append((1 + words[0] % (FIRST - 1), words[1] % FIRST, 1 + words[2] % (SECOND - 1), words[3] % SECOND))
    a, b = _radices(n)
    net = Network(a, b, tuple(shifts), 0)
    # Numbers beyond n that are still there after some steps; those on a cycle beyond n are never reached from below.
    beyond, again = np.arange(n, a * b, dtype=np.int64), 0
    while len(beyond):
        moved = _turned(beyond, net)
        again += 1
        moved = np.sort(moved[moved >= n])
        if np.array_equal(moved, np.sort(beyond)):
            again -= 1
            break
        beyond = moved
    return Network(a, b, tuple(shifts), again)


def permute(stage: Stage, value: Column, n: int, key: str, scope: str) -> Column:
    """Where `value` in [0, n) goes; each turn is plain arithmetic on the digits of the one before."""
    net = network(key, scope, n)

    def whole(v: int) -> Column:
        return F.lit(v).cast("bigint")

    def shift(x: Column, c: tuple[int, int, int, int], radix: int) -> Column:
        return ((x * whole(c[0]) + whole(c[1])) % FIRST * whole(c[2]) + whole(c[3])) % SECOND % whole(radix)

    def div(x: Column) -> Column:
        return F.call_function("div", x, whole(net.b))

    x = stage.keep(value.cast("bigint"))
    for step in range(1 + net.again):
        high, low = stage.keep_all([div(x), x % whole(net.b)])
        for i in range(0, 2 * TURNS, 2):
            shifted = (high + shift(low, net.shifts[i], net.a)) % whole(net.a)
            high, low = stage.keep_all([shifted, (low + shift(shifted, net.shifts[i + 1], net.b)) % whole(net.b)])
        moved = high * whole(net.b) + low
        x = moved if step == net.again == 0 else stage.keep(moved if step == 0 else F.when(x >= whole(n), moved).otherwise(x))
    return x


def permute_sql(x: str, n: int, key: str, scope: str, source: str, keep: str) -> str:
    """The same as SQL: `keep` columns and column `x` of `source`, as nested selects."""
    net = network(key, scope, n)

    def shift(v: str, c: tuple[int, int, int, int], radix: int) -> str:
        return f"(((({v} * {c[0]} + {c[1]}) % {FIRST}) * {c[2]} + {c[3]}) % {SECOND} % {radix})"

    sql = f"SELECT {keep}, cast({x} AS bigint) AS x FROM ({source})"
    for step in range(1 + net.again):
        sql = f"SELECT {keep}, x, x // {net.b} AS h, x % {net.b} AS l FROM ({sql})"
        for i in range(0, 2 * TURNS, 2):
            sql = f"SELECT {keep}, x, (h + {shift('l', net.shifts[i], net.a)}) % {net.a} AS h, l FROM ({sql})"
            sql = f"SELECT {keep}, x, h, (l + {shift('h', net.shifts[i + 1], net.b)}) % {net.b} AS l FROM ({sql})"
        sql = f"SELECT {keep}, CASE WHEN {step} = 0 OR x >= {n} THEN h * {net.b} + l ELSE x END AS x FROM ({sql})"
    return sql
