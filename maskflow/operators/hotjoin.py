"""Mapping values back onto a table when single values may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions.stage import PREFIX

HOT_SHARE = 2000
ROWS_PER_TASK = 4_000_000
NULL_SALTS = 4096
HELPERS = (PREFIX, "__pick_")


def row_hash(d: DataFrame) -> Column:
    """A hash of the whole row; types without a hash take no part in it. Nor do helper columns: they follow from the others,
    and would have to be kept for the hash of the next join."""
    fields = [f.name for f in d.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    given = [c for c in fields if not c.startswith(HELPERS)] or fields
    return F.xxhash64(*[F.col(f"`{c.replace('`', '``')}`") for c in given])


def cuts_joins(df: DataFrame) -> bool:
    """Whether Spark cuts the large partitions of a merge join of `df` by itself, at the sizes set for it; not in a stream."""
    set_ = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return not df.isStreaming and all(df.sparkSession.conf.get(s, "true") == "true" for s in set_)


def salted_join(
    df: DataFrame, table: DataFrame, same: Column, salts: int, alone: Column | None = None, own: tuple[Column, Column] | None = None
) -> DataFrame:
    """Left join with a lookup that is too large to broadcast: rows are dealt over `salts` copies of it, so that no key,
    null included, brings more than its share of 1/salts of the rows that have it to one task. Rows that are `alone`
    match nothing and are dealt over as many salts as there may be tasks. Where `salts` need not be the same for all keys,
    `own` are those of a row and the copies of a table row, equal for equal keys.

    Spark would judge the copies by the size of the file that the table comes from, and broadcast them.
    """
    dealt, copied = own or (F.lit(salts), F.lit(salts))
    dealt = dealt if alone is None else F.when(alone, NULL_SALTS).otherwise(dealt)
    d = df.withColumn("__join_salt", F.pmod(row_hash(df), dealt).cast("int"))
    copies = table.withColumn("__join_copy", F.explode(F.sequence(F.lit(0), copied - 1))).hint("merge")
    return d.join(copies, same & (F.col("__join_salt") == F.col("__join_copy")), "left").drop("__join_salt", "__join_copy")


def map_back(df: DataFrame, value: Column, mapping: DataFrame, rows: int, small: bool, into: str) -> DataFrame:
    """Add `into`: the `new` of the `mapping(old, new, n)` row whose `old` equals `value`.

    `n` is how many of the `rows` table rows hold `old`. A small mapping is broadcast. Otherwise both sides are
    shuffled once by value and salt: a value that holds more than 1/2000 of the rows, or more than a task should
    read, gets as many salts as it has such shares. The table itself is read in a single branch, so that several
    such columns do not multiply its scans. Only the salts of those hot values are broadcast. Nulls are spread.
    """
    d = df.withColumn("__map_key", value)
    pairs = mapping.select(F.col("old").alias("__map_old"), F.col("new").alias(into), "n")
    if small:
        joined = d.join(F.broadcast(pairs.drop("n")), F.col("__map_key") == F.col("__map_old"), "left")
        return joined.drop("__map_key", "__map_old")
    limit = max(1, min(rows // HOT_SHARE, ROWS_PER_TASK))
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = mapping.filter(F.col("n") > limit).select(F.col("old").alias("__map_hot"), salts.alias("__map_salts"))
    spread = row_hash(d)  # of equal rows all get one salt
    number = F.when(F.col("__map_key").isNull(), NULL_SALTS).otherwise(F.coalesce("__map_salts", F.lit(1)))
    d = d.join(F.broadcast(hot), F.col("__map_key") == F.col("__map_hot"), "left")
    d = d.withColumn("__map_salt", F.pmod(spread, number).cast("int")).drop("__map_hot", "__map_salts")
    dealt = pairs.withColumn("__map_place", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    same = (F.col("__map_key") == F.col("__map_old")) & (F.col("__map_salt") == F.col("__map_place"))
    return d.join(dealt, same, "left").drop("__map_key", "__map_salt", "__map_old", "__map_place")
