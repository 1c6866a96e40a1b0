"""Connected components of a graph given by its links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.session import materialise


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `root` (the smallest node of its component) of every node that has a link; nodes are not null.

    Each round hangs the larger neighbours of a node under its smallest one, then the smaller ones (Kiveris et al.,
    "Connected Components in MapReduce and Beyond"); the number of rounds grows with the logarithm of the longest path.
    A node with very many links is a hot key of a plain join only, which Spark can split; minima are pre-aggregated.
    Each round is written to the shared folder. No links give no rows.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    pairs = materialise(pairs, "links")
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialise(moved.unionByName(below.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
