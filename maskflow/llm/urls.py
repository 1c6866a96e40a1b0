"""URL filter: rules first, then per host a tree of path templates judged by the share of labelled URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.html import host_of, path_of
from maskflow.session import materialise

#: Segments that name one page: numbers, dates, hashes, ids with digits, with or without an ending.
VARIABLE = r"^(?:[0-9][0-9._-]*|[0-9a-f]{8,}(?:-[0-9a-f]{4,})*|[^.]*[0-9]{3,}[^.]*)(?:\.[a-z0-9]{1,5})?$"


@dataclass(frozen=True)
class Settings:
    depth: int = 8  # segments that get a level of their own; those beyond are one tail
    least: int = 20  # rows that a branch of its own needs
    apart: float = 2.6  # standard errors by which its share of bad labels differs from its siblings'
    weight: float = 10.0  # labelled rows that the share of the level above counts as
    reject: float = 0.7  # smoothed share of bad labels from which a template is blocked


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (text order breaks ties) and its verdict, or nulls; a rule is (host/path start, verdict)."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def templates(urls: DataFrame, settings: Settings) -> DataFrame:
    """host, path and template of distinct paths: `urls` has host, path, n rows, of them `labelled`, of them `bad`.

    Level by level from the host: a segment stays as it is where it is no number or the like, has `least` rows below
    its parent and a share of bad labels that is statistically apart from its siblings'; all others are one wildcard.
    """
    cut = F.split(F.regexp_replace("path", "^/+", ""), "/", settings.depth)
    state = materialise(urls.withColumns({"segments": cut, "template": F.lit("")}), "urls")
    deep = state.agg(F.max(F.size("segments"))).first()[0] or 0
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    for level in range(deep):
        segment = F.get("segments", F.lit(level))
        here = state.where(segment.isNotNull()).select("host", "template", segment.alias("s"), "n", "labelled", "bad")
        child = here.where(~F.col("s").rlike(VARIABLE)).groupBy("host", "template", "s").agg(*sums)
        total = here.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        both = child.where(F.col("n") >= settings.least).join(total, ["host", "template"])
        rest, rate = F.col("l") - F.col("labelled"), F.col("b") / F.col("l")
        gap = F.abs(F.col("bad") / F.col("labelled") - (F.col("b") - F.col("bad")) / rest)
        error = F.sqrt(rate * (1 - rate) * (1 / F.col("labelled") + 1 / rest))
        kept = both.where("labelled > 0 and labelled < l").where((gap > 0) & (gap >= settings.apart * error)).select("host", "template", "s")
        marked = state.withColumn("s", segment).join(kept.withColumn("own", F.lit(True)), ["host", "template", "s"], "left")
        step = F.when(F.col("own"), F.col("s")).otherwise(F.lit("*"))
        grown = F.when(F.col("s").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step))
        state = materialise(marked.withColumn("template", grown).drop("s", "own"), "urls")
    return state.select("host", "path", "template", "n", "labelled", "bad")


def judged(known: DataFrame, settings: Settings) -> DataFrame:
    """`purity` of each host and template: its share of bad labels, smoothed by its host's, and that by the whole's."""
    whole = known.agg(F.sum("bad"), F.sum("labelled")).first()
    base = ((whole[0] or 0) + 1.0) / ((whole[1] or 0) + 2.0)

    def smooth(prior: Column) -> Column:
        return (F.col("bad") + settings.weight * prior) / (F.col("labelled") + settings.weight)

    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    hosts = known.groupBy("host").agg(*sums).select("host", smooth(F.lit(base)).alias("prior"))
    tree = known.groupBy("host", "template").agg(*sums).join(hosts, "host")
    return tree.select("host", "template", "labelled", smooth(F.col("prior")).alias("purity"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (share of bad) of every row of `pages`.

    The method decides where no rule fits. It learns from the rules' own verdicts, or from `labels` (page_id, bad: 0
    or 1) where given; labels of one page that disagree count as bad. URLs are counted once for each host and path
    before anything is joined. Null URLs and ones without `://` have an empty host and path and are allowed. Null and
    repeated ids and repeated rows are judged by their URL; an empty table gives no rows.
    """
    named = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "_says": verdict})
    if labels is None:
        marked = named.withColumn("_bad", F.when(F.col("_says").isNotNull(), (F.col("_says") == "block").cast("int")))
    else:
        given = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("_bad"))
        marked = named.join(given, "page_id", "left")
    counted = marked.where("host <> ''").groupBy("host", "path")
    counted = counted.agg(F.count("*").alias("n"), F.count("_bad").alias("labelled"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    known = templates(counted, settings)
    tree = judged(known, settings)
    paths = known.select("host", "path", "template").join(tree.drop("labelled"), ["host", "template"])
    found = named.join(paths, ["host", "path"], "left")
    blocked = F.coalesce(F.col("purity") >= settings.reject, F.lit(False))
    says = F.coalesce("_says", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", says.alias("verdict"), "template", "purity")
