"""Mixing sources to target weights: tempered token shares, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import WORD
from maskflow.session import BROADCAST_BYTES, materialise


@dataclass(frozen=True)
class Settings:
    """One target: `repetition` (how often the most repeated source is read for each pass over the least repeated
    one) or `entropy` (of the weights, as a share of the logarithm of the number of sources)."""

    repetition: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None  # tokens of the mixture; None: the least that reads every source whole at least once
    blocks: int = 1024  # of each source; a source's last pass is exact to half a block
    seed: int = 17
    trials: int = 32  # exponents that one job tries
    rounds: int = 6


def tokens_of(text: str) -> Column:
    """Words and one end."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) + 1).cast("long")


def tried(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy of the weights over the logarithm of the number of sources, spread of weight over share)."""
    p, a = F.col("p"), F.col("a")
    rows = shares.select("p", F.explode(F.array(*[F.lit(x) for x in exponents])).alias("a"))
    found = rows.groupBy("a").agg(
        F.sum(F.pow(p, a)).alias("z"),
        F.sum(F.pow(p, a) * a * F.log(p)).alias("e"),
        (F.max(F.pow(p, a - 1)) / F.min(F.pow(p, a - 1))).alias("spread"),
        F.count("*").alias("n"),
    )
    return sorted((r.a, (math.log(r.z) - r.e / r.z) / math.log(r.n) if r.n > 1 else 1.0, r.spread) for r in found.collect())


def exponent(shares: DataFrame, settings: Settings) -> float:
    """The smallest exponent in 0..1 that meets the limit; each job cuts the interval into `trials` parts, not two.

    Smaller exponents flatten the weights: entropy falls and so does the spread as the exponent grows. A limit that
    holds everywhere gives 0 (equal weights), one that holds nowhere 1 (shares as they are).
    """
    low, high = 0.0, 1.0
    for _ in range(settings.rounds):
        steps = [low + (high - low) * k / settings.trials for k in range(settings.trials + 1)]
        fits = [
            spread <= settings.repetition if settings.repetition is not None else entropy <= settings.entropy
            for _, entropy, spread in tried(shares, steps)
        ]
        first = fits.index(True) if True in fits else settings.trials
        if first == 0:
            return steps[0]
        low, high = steps[first - 1], steps[first]
    return high


def mix(docs: DataFrame, settings: Settings = Settings(), text: str = "text", source: str = "source") -> DataFrame:
    """`docs` once for each pass that reads them, with mix_tokens, mix_pass (from 0), mix_order and mix_weight.

    A source of T tokens and weight w is read w * budget / T times: whole passes, and one that ends at the block
    where the budget is reached. Every pass has the source's blocks in another order; `mix_order` (0 to 1) is the
    place in the source's stream, so that sorting by it interleaves the sources at their weights.
    Null sources are one source. Blocks come from a hash of doc_id and the text, so that repeated rows stay together.
    Null and empty texts count one token; an empty table gives no rows.
    """
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("doc_id"), F.col(text)), F.lit(settings.blocks))
    marked = docs.withColumns({"_name": name, "mix_tokens": tokens_of(text), "_block": block})
    sums = materialise(marked.groupBy("_name", "_block").agg(F.sum("mix_tokens").alias("t")), "blocks")
    sources = sums.groupBy("_name").agg(F.sum("t").alias("total"))
    whole = sources.agg(F.sum("total")).first()[0] or 1
    shares = materialise(sources.withColumn("p", F.col("total") / F.lit(whole)), "shares")
    a = exponent(shares, settings) if shares.head(1) else 1.0
    z, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.min(F.pow("p", F.lit(a - 1)))).first()
    budget = settings.budget or whole * (z or 1.0) / (least or 1.0)
    weighed = shares.withColumn("mix_weight", F.pow("p", F.lit(a)) / F.lit(z or 1.0))
    weighed = weighed.withColumn("reads", F.col("mix_weight") * F.lit(float(budget)) / F.col("total"))
    weighed = weighed.withColumn("reads", F.col("reads") * (1 + 1e-9))  # a whisker below a whole number is that number
    passes = sums.join(weighed.select("_name", "total", "reads", "mix_weight"), "_name")
    passes = passes.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.floor("reads").cast("int"))))
    place = F.xxhash64(F.lit(settings.seed + 1), "mix_pass", "_name", "_block")
    order = Window.partitionBy("_name", "mix_pass").orderBy(place, "_block").rowsBetween(Window.unboundedPreceding, -1)
    passes = passes.withColumn("ahead", F.coalesce(F.sum("t").over(order), F.lit(0)))
    read = (F.col("mix_pass") < F.floor("reads")) | (F.col("ahead") + F.col("t") / 2 <= (F.col("reads") - F.col("mix_pass")) * F.col("total"))
    passes = passes.where(read).withColumn("mix_order", (F.col("mix_pass") + F.col("ahead") / F.col("total")) / F.col("reads"))
    passes = materialise(passes.select("_name", "_block", "mix_pass", "mix_order", "mix_weight"), "passes")
    small = passes.agg(F.sum(F.length("_name") + 64)).first()[0] or 0
    side = F.broadcast(passes) if small <= BROADCAST_BYTES // 4 else passes
    return marked.join(side, ["_name", "_block"]).drop("_name", "_block")
