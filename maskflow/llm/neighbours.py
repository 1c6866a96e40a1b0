"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy searches on it, as Spark joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import ship
from maskflow.session import materialise

ship(__name__)


@dataclass(frozen=True)
class Settings:
    neighbours: int = 24  # kept for each node
    reverse: int = 24  # nodes that point at a node, drawn by a hash, which join its neighbourhood
    propose: int = 4  # best new pairs that one neighbourhood gives each of its members
    starts: int = 8  # groupings by the nearest of some sampled nodes, whose members are compared with each other at first
    group: int = 1024  # rows of such a group, on average; larger groups are split
    first: int = 8  # nearest members of its group that a node takes from each grouping
    rounds: int = 12  # of NN-descent, unless fewer than `still` of the links are new
    still: float = 0.03
    pivots: int = 1024  # a bounded sample of nodes where groups gather, in each grouping, and where searches begin
    beam: int = 160  # best nodes that a search keeps; it ends when all of them have been expanded
    expand: int = 64  # of them in one round
    rerank: int = 48  # best nodes that are scored exactly


def usable(vector: str) -> Column:
    """Vectors of finite components that are not all zero."""
    parts = F.col(vector)
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return parts.isNotNull() & (F.size(parts) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(parts, lambda x: x != 0)


def classes(vectors: DataFrame, key: str, vector: str, copies: int) -> DataFrame:
    """Distinct usable vectors: id (their smallest), ids (the `copies` smallest, in order), vector and short.

    Copies have equal nearness to everything, so that with ties to smaller ids no others can be among the nearest.
    `short` is the direction in bytes, for the graph. Vectors of another length than most take no part.
    """
    kept = vectors.where(F.col(key).isNotNull()).where(usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    common = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return kept.select("id", F.array("id").alias("ids"), "vector", F.lit(b"").alias("short")).limit(0)
    kept = kept.where(F.size("vector") == common.n).distinct()
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    listed = kept.withColumn("r", first).where(F.col("r") <= copies).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    @F.pandas_udf("binary")
    def shortened(rows: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, dtype=np.float64) for r in rows]) if len(rows) else np.zeros((0, 1))
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        # Components of a direction are about 1 / sqrt(n); those beyond five times that are cut.
        x = np.clip(np.rint(x * (127 * np.sqrt(x.shape[1]) / min(5.0, np.sqrt(x.shape[1])))), -127, 127).astype(np.int8)
        return pd.Series([r.tobytes() for r in x])

    return listed.select(F.col("ids")[0].alias("id"), "ids", "vector", shortened("vector").alias("short"))


def directions(short) -> np.ndarray:
    x = np.frombuffer(b"".join(short), dtype=np.int8).reshape(len(short), -1).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


Work = Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]


def grouped(df: DataFrame, key: str, order: list[str], work: Work, schema: str) -> DataFrame:
    """`work` on whole groups of sorted rows and where each begins, a batch of groups at a time.

    Keys have a bounded number of rows each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
            cuts = np.append(0, np.flatnonzero(np.diff(batch[key].to_numpy())) + 1)
            left = batch.iloc[cuts[-1] :].reset_index(drop=True)
            if len(cuts) > 1:
                yield work(batch.iloc[: cuts[-1]], cuts[:-1])
        if left is not None and len(left):
            yield work(left, np.zeros(1, dtype=np.int64))

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def best(graph: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node in links (a, b, s, new); a link that is not new stays so."""
    one = graph.groupBy("a", "b").agg(F.max("s").alias("s"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return one.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def reversed_links(graph: DataFrame, slots: int, seed: int) -> DataFrame:
    """At most `slots` links (v, u, new) from a node to ones that point at it, one for each slot of a hash."""
    slot = F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(slots))
    drawn = graph.groupBy(F.col("b").alias("v"), slot.alias("slot")).agg(F.min(F.struct("a", "new")).alias("x"))
    return drawn.select("v", F.col("x.a").alias("u"), F.col("x.new").alias("new"))


def first_groups(nodes: DataFrame, n: int, settings: Settings) -> DataFrame:
    """(g, id, short): every node once in each grouping, with nodes near the same pivot; a large group is split by a hash."""
    per_start = min(settings.pivots, -(-n // settings.group))
    starts = settings.starts if per_start > 1 else 1
    sample = nodes.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(per_start * starts).select("short").toPandas()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots = directions(sample.short)
        for batch in batches:
            if not len(batch):
                continue
            x = directions(batch.short)
            for start in range(starts):
                near = np.argmax(x @ pivots[start::starts].T, axis=1)
                yield pd.DataFrame({"cell": start * per_start + near, "id": batch.id, "short": batch.short})

    dealt = nodes.mapInPandas(deal, "cell long, id long, short binary")
    # At most pivots * starts rows.
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2 * settings.group)).alias("parts"))
    part = F.pmod(F.xxhash64("cell", "id"), F.col("parts"))
    return dealt.join(F.broadcast(parts), "cell").select(F.xxhash64("cell", part).alias("g"), "id", "short")


def neighbour_graph(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b, s) from each node (id, short) to its nearest known ones, by NN-descent."""
    n = nodes.count()
    alone = n <= settings.group
    k, m = settings.neighbours, settings.propose
    first = k if alone else settings.first

    def compare(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        """The nearest members of its group for each row."""
        out = []
        for at, end in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
            ids, x = rows.id.to_numpy()[at:end], directions(rows.short.iloc[at:end])
            s = x @ x.T
            np.fill_diagonal(s, -2)
            top = np.argpartition(-s, min(first, len(ids) - 1), axis=1)[:, :first]
            a, b = np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()
            kept = a != b
            out.append(pd.DataFrame({"a": ids[a[kept]], "b": ids[b[kept]], "s": s[a[kept], b[kept]]}))
        return pd.concat(out, ignore_index=True)

    def join(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        """The best new pairs for each member of a neighbourhood; all neighbourhoods of a batch are one stack of matrices."""
        v, u = rows.v.to_numpy(), rows.u.to_numpy()
        again = np.append(False, (v[1:] == v[:-1]) & (u[1:] == u[:-1]))
        at = np.flatnonzero(~again)
        new = np.logical_or.reduceat(rows.new.to_numpy(dtype=bool), at)
        v, u, least = v[at], u[at], rows.least.to_numpy()[at]
        begin = np.append(True, v[1:] != v[:-1])
        group = np.cumsum(begin) - 1
        place = np.arange(len(v)) - np.flatnonzero(begin)[group]
        shape = (group[-1] + 1, place.max() + 1)
        x = directions(rows.short.iloc[at])
        stack = np.zeros((*shape, x.shape[1]), dtype=np.float32)
        ids, fresh, bar = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool), np.full(shape, 2, dtype=np.float32)
        real = np.zeros(shape, dtype=bool)
        stack[group, place], ids[group, place], fresh[group, place], bar[group, place], real[group, place] = x, u, new, least, True
        s = stack @ stack.transpose(0, 2, 1)
        s[~((fresh[:, :, None] | fresh[:, None, :]) & real[:, :, None] & real[:, None, :] & (s > bar[:, :, None]))] = -2
        s[:, np.arange(shape[1]), np.arange(shape[1])] = -2
        top = np.argpartition(-s, min(m, shape[1] - 1), axis=2)[:, :, :m]
        best_ = np.take_along_axis(s, top, axis=2)
        g, a, t = np.nonzero(best_ > -2)
        return pd.DataFrame({"a": ids[g, a], "b": ids[g, top[g, a, t]], "s": best_[g, a, t]})

    link = "a long, b long, s float"
    dealt = nodes.withColumn("g", F.lit(0).cast("long")) if alone else first_groups(nodes, n, settings)
    begun = grouped(dealt.select("g", "id", "short"), "g", [], compare, link)
    graph = materialise(best(begun.withColumn("new", F.lit(True)), k), "graph")
    for number in range(0 if alone else settings.rounds):
        members = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "new").unionByName(reversed_links(graph, settings.reverse, number))
        least = graph.groupBy("a").agg(F.when(F.count("*") < k, -1.0).otherwise(F.min("s")).cast("float").alias("least"))
        vectors = nodes.join(least, nodes.id == least.a, "left").select(F.col("id").alias("u"), "short", F.coalesce("least", F.lit(-1.0)).cast("float").alias("least"))
        proposed = grouped(members.join(vectors, "u"), "v", ["u"], join, link).withColumn("new", F.lit(True))
        graph = materialise(best(graph.withColumn("new", F.lit(False)).unionByName(proposed), k), "graph")
        if graph.where("new").count() < settings.still * k * n:
            break
    return graph.select("a", "b", "s")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, settings: Settings) -> DataFrame:
    """(q, c) of the best nodes that greedy searches find for queries (q, short), in rounds of joins.

    A query is a node itself: its search begins there and at the nearest pivots.
    """
    slot = F.pmod(F.xxhash64(F.lit(-1), "a", "b"), F.lit(settings.reverse))
    back = graph.groupBy("b", slot.alias("slot")).agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("c"))
    links = graph.select(F.col("a").alias("node"), F.col("b").alias("c")).unionByName(back).distinct()
    links = materialise(links.groupBy("node").agg(F.collect_list("c").alias("cs")), "links")  # both sides are bounded
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(settings.pivots).select("id", "short").toPandas()
    beam, expand = settings.beam, settings.expand

    def chosen(q: int, short: bytes, ids: np.ndarray, sims: np.ndarray, done: np.ndarray, seen: np.ndarray) -> dict:
        order = np.lexsort((ids, -sims))[:beam]
        ids, sims, done = ids[order], sims[order], done[order]
        ask = np.flatnonzero(~done)[:expand]
        done[ask] = True
        return {
            "q": q,
            "short": short,
            "ids": ids.tobytes(),
            "sims": sims.astype(np.float32).tobytes(),
            "done": done.tobytes(),
            "seen": seen.tobytes(),
            "ask": ids[ask].tolist(),
        }

    state_schema = "q long, short binary, ids binary, sims binary, done binary, seen binary, ask array<long>"
    columns = ["q", "short", "ids", "sims", "done", "seen", "ask"]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = sample.id.to_numpy(), directions(sample.short)
        for batch in batches:
            out = []
            for q, short in zip(batch.q, batch.short, strict=True):
                own, others = np.int64(q), ids != q
                sims = x[others] @ directions([short])[0]
                known = np.append(own, ids[others])
                out.append(chosen(q, short, known, np.append(np.float32(1), sims), np.zeros(len(known), bool), np.sort(known)))
            yield pd.DataFrame(out, columns=columns)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                seen = np.frombuffer(row.seen, dtype=np.int64)
                ids, sims = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.sims, dtype=np.float32)
                done = np.frombuffer(row.done, dtype=bool).copy()
                if row.cs is not None and len(row.cs):
                    c = np.asarray(row.cs, dtype=np.int64)
                    fresh = np.flatnonzero(~np.isin(c, seen))
                    if len(fresh):
                        c = c[fresh]
                        s = directions([row.shorts[i] for i in fresh]) @ directions([row.short])[0]
                        ids, sims, done = np.append(ids, c), np.append(sims, s), np.append(done, np.zeros(len(c), bool))
                        seen = np.union1d(seen, c)
                out.append(chosen(row.q, row.short, ids, sims, done, seen))
            yield pd.DataFrame(out, columns=columns)

    state = materialise(queries.select("q", "short").mapInPandas(begin, state_schema), "searches")
    while state.where(F.size("ask") > 0).head(1):
        requests = state.select("q", F.explode("ask").alias("node")).join(links, "node")
        pairs = requests.select("q", F.explode("cs").alias("c")).distinct()
        found = pairs.join(nodes.select(F.col("id").alias("c"), F.col("short").alias("x")), "c")
        # At most expand * (neighbours + reverse) rows of a query.
        found = found.groupBy("q").agg(F.collect_list(F.struct("c", "x")).alias("f"))
        asked = state.join(found, "q", "left").withColumns({"cs": F.col("f.c"), "shorts": F.col("f.x")}).drop("f")
        state = materialise(asked.mapInPandas(step, state_schema), "searches")

    def ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best_ = [np.frombuffer(b, dtype=np.int64)[: settings.rerank] for b in batch.ids]
            yield pd.DataFrame({"q": np.repeat(batch.q.to_numpy(), [len(b) for b in best_]), "c": np.concatenate([*best_, np.array([], dtype=np.int64)])})

    return state.select("q", "ids").mapInPandas(ended, "q long, c long")


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score (cosine in double precision) of the k nearest found for each query row.

    Queries are rows whose key is divisible by `every`, candidates all rows but the query's own. Null, zero and
    non-finite vectors, null keys and vectors of another length than most take no part. Equal vectors are one node
    of the graph, so that a large group of copies costs nothing; ties go to smaller keys. Repeated rows count once.
    With few rows all candidates are returned.
    """
    nodes = materialise(classes(vectors, key, vector, k + 1), "nodes")
    light = nodes.select("id", "short")
    graph = neighbour_graph(light, settings)
    own = vectors.where(F.col(key) % every == 0).where(usable(vector)).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("vector")).distinct()
    own = own.join(nodes.select("vector", F.col("id").alias("q"), "short"), "vector")
    found = search(own.select("q", "short").distinct(), light, graph, settings)
    scored = own.select("query_id", "q", F.col("vector").alias("x")).join(found, "q")
    scored = scored.join(nodes.select(F.col("id").alias("c"), "ids", F.col("vector").alias("y")), "c")
    scored = scored.select("query_id", "ids", cosine("x", "y").alias("score"))
    listed = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a: str, b: str) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    x, y = F.col(a), F.col(b)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
