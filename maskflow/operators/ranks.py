"""Exact ranks and order statistics without sorting a whole table in one task.

Rows are split by the leading hex digits of a digest, so the buckets are even whatever the data looks
like; each bucket is ranked on its own and shifted by the running total of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A measured table of this size is ranked in one task.
SMALL_ROWS = 100_000

_BUCKET = "__rank_bucket"
_SHIFT = "__rank_shift"
_WEIGHT = "__rank_weight"


def bucket_digits(rows: int) -> int:
    """Hex digits that leave at most about a million rows per bucket (256 to 1,048,576 buckets)."""
    digits = 2
    while digits < 5 and rows > (16**digits) * 1_000_000:
        digits += 1
    return digits


def positions(
    df: DataFrame,
    dg: Column,
    name: str,
    weight: Column | None = None,
    groups: tuple[str, ...] = (),
    digits: int = 2,
    rows: int | None = None,
    no_nulls: bool = False,
) -> DataFrame:
    """Add `name`: the total weight of the rows that sort before this one by digest, within its group.

    With weight 1 this is the zero-based rank. `rows` is the measured size of `df`, if known: up to
    `SMALL_ROWS` one window per group is enough. With `no_nulls` in the groups the ranked rows stay where they are when
    they are shifted; Spark, which would judge them by the size of their file, does not broadcast them.
    """
    if rows is not None and rows <= SMALL_ROWS:
        own = F.lit(1) if weight is None else weight
        window = Window.partitionBy(*(groups or (F.lit(0),))).orderBy(dg).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(own.cast("bigint")).over(window), F.lit(0)))
    d = df.withColumn(_BUCKET, F.substring(dg, 1, digits)).withColumn(
        _WEIGHT, F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    )
    keys = [*groups, _BUCKET]
    totals = d.groupBy(*keys).agg(F.sum(_WEIGHT).alias("__rank_total"))
    # One row per group and bucket: without groups at most 16^digits rows pass this window.
    before = Window.partitionBy(*(groups or (F.lit(0),))).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, F.coalesce(F.sum("__rank_total").over(before), F.lit(0)).alias(_SHIFT))
    if not groups:
        shifts = F.broadcast(shifts)
    inside = Window.partitionBy(*keys).orderBy(dg).rowsBetween(Window.unboundedPreceding, -1)
    # Dealt first: the digests, which are long and do not compress, are made where the rows are ranked.
    ranked = d.repartition(*keys).withColumn(name, F.coalesce(F.sum(_WEIGHT).over(inside), F.lit(0)))
    if not groups:
        joined = ranked.join(shifts, keys, "inner")
    elif no_nulls:
        joined = ranked.join(shifts.hint("merge"), keys, "inner")
    else:
        joined = _null_safe_join(ranked, shifts, keys)
    return joined.withColumn(name, F.col(name) + F.col(_SHIFT)).drop(_BUCKET, _SHIFT, _WEIGHT)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], _SHIFT)
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, "inner").drop(*[f"__r_{k}" for k in keys])


def nth_digest(ids: DataFrame, dg: Column, n: int, digits: int = 2) -> Column:
    """The `n`-th smallest digest (from 1) as a scalar subquery.

    `digest <= nth_digest` then marks exactly `n` rows: the rows themselves are never shuffled, only
    bucket counts and the one bucket that holds the answer.
    """
    d = ids.select(dg.alias("__digest")).withColumn(_BUCKET, F.substring("__digest", 1, digits))
    counts = d.groupBy(_BUCKET).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(F.lit(0)).orderBy(_BUCKET)
    crossing = (
        counts.withColumn("__upto", F.sum("__n").over(upto))
        .filter((F.col("__upto") >= n) & (F.col("__upto") - F.col("__n") < n))
        .select(_BUCKET, (F.lit(n) - (F.col("__upto") - F.col("__n"))).alias("__need"))
    )
    # `crossing` has one row.
    inside = d.join(F.broadcast(crossing), _BUCKET)
    ranked = inside.withColumn("__rank", F.row_number().over(Window.partitionBy(_BUCKET).orderBy("__digest")))
    return ranked.filter(F.col("__rank") == F.col("__need")).agg(F.max("__digest").alias("nth")).scalar()
