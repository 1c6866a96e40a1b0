"""MinHash near-duplicates by an LSH forest: documents in several orders of their signatures.

Each tree sorts all distinct shingle sets by eight MinHash values, dealt by ranges, so that no key is ever one task's
alone. Neighbours with a long common prefix are candidates: in sparse regions four values suffice and all neighbours of
a run are compared; in dense ones it takes six, and in very dense ones eight, to join a cluster. Sets of a cluster meet
once, in blocks of bounded work, and are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import ship
from maskflow.llm.components import components
from maskflow.llm.hashing import shingle_hashes
from maskflow.operators.hotjoin import map_back
from maskflow.session import materialise

ship(__name__)

TREES, DEPTH = 24, 8  # orders, and 16-bit values in each; a tree misses a pair of likeness s at depth d with 1 - s^d
SPARSE, DENSE = 16, 4096  # rows of a run up to which it is sparse, and of a deeper run up to which it is dense
SHALLOW, DEEP = 4, 6
FLIPS = 20  # of 64 single bits that sparse neighbours may differ in: 5 are expected at a likeness of 0.85
ROWS = 1_000_000  # sorted rows of a task, about
WORK = 1 << 28  # sets times shingles of a block that is compared with itself
HASHES = 1 << 22  # shingles of a block at most, if it has several sets
SMALL_CLUSTERS = 200_000  # clusters of several blocks up to which their table is broadcast
SMALL_SETS = 200_000


# Signatures


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_612)
    size = (TREES * DEPTH, 1)
    return draw.integers(0, 1 << 32, size, dtype=np.uint32), draw.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(hashes: np.ndarray, turned: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes, one for each pair of constants."""
    least = np.full(len(turned), 0xFFFFFFFF, dtype=np.uint32)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 2048):
        x = low[None, at : at + 2048] ^ turned
        x *= scaled
        np.minimum(least, x.min(1), out=least)
    return least


def signature(least: np.ndarray) -> tuple[np.ndarray, int]:
    """The trees' keys (two longs each, four values a long) and 64 single bits."""
    mixed = least * np.uint32(0x9E3779B1)  # the least values start with zeros; odd multiples do not
    values = (mixed >> np.uint32(16)).astype(np.uint16).reshape(TREES, DEPTH)
    bits = np.packbits((mixed[:: len(mixed) // 64][:64] & np.uint32(0x8000)) > 0)
    # Unsigned values are sorted as signed longs; only equal prefixes matter, not which ones come first.
    return values.astype(">u2").view(">i8").astype(np.int64), int(bits.view(">i8")[0])


def marks(text: str | Column, size: int) -> Column:
    """(n, digest, keys, bits) of a text's set of shingles; no digest without words."""
    turned, scaled = _constants()

    @F.pandas_udf("n long, digest binary, keys array<long>, bits long")
    def computed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for hashes in shingle_hashes(texts, size, 42):
            h = np.unique(hashes)
            if not len(h):
                rows.append((0, None, None, None))
                continue
            keys, bits = signature(minima(h, turned, scaled))
            rows.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), keys.ravel(), bits))
        return pd.DataFrame(rows, columns=["n", "digest", "keys", "bits"])

    return computed(F.col(text) if isinstance(text, str) else text)


# Trees


def runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's run and the rows of that run; `same` says whether a row continues the one before."""
    number = np.cumsum(~same) - 1
    return number, np.bincount(number, minlength=1)[number]


def neighbours(tree: np.ndarray, hi: np.ndarray, lo: np.ndarray, bits: np.ndarray, node: np.ndarray, open_start: bool, open_end: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidates (a, b) among sorted rows; a run at an open end may go on elsewhere and counts as dense."""

    def continues(value: np.ndarray) -> np.ndarray:
        same = np.zeros(len(tree), dtype=bool)
        same[1:] = (tree[1:] == tree[:-1]) & (hi[1:] == hi[:-1]) & (value[1:] == value[:-1])
        return same

    shallow = continues(np.zeros_like(lo))
    run, size = runs(shallow)
    cut = (open_start & (run == run[0])) | (open_end & (run == run[-1]))
    out = []
    at = np.flatnonzero((size > 1) & (size <= SPARSE) & ~cut)
    for step in range(1, SPARSE):
        a = at[at < len(run) - step]
        a = a[run[a] == run[a + step]]
        if not len(a):
            break
        near = np.bitwise_count((bits[a] ^ bits[a + step]).view(np.uint64)) <= FLIPS  # of signed values it would count the absolute
        out.append((node[a[near]], node[a[near] + step]))
    six, sized = runs(continues(lo >> 32))
    eight, _ = runs(continues(lo))
    dense = (size > SPARSE) | cut
    for numbers, rows in ((run, dense & (size <= SPARSE)), (six, dense & (size > SPARSE) & (sized <= DENSE)), (eight, dense & (size > SPARSE) & (sized > DENSE))):
        first = np.unique(numbers, return_index=True)[1][numbers]
        a = np.flatnonzero(rows & (first != np.arange(len(first))))
        out.append((node[first[a]], node[a]))
    return out


def _tree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of one range of the sorted rows, and its two ends (their place, tree, key and node)."""
    from pyspark import TaskContext

    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    del parts
    tree, hi, lo, bits, node = (rows[c].to_numpy() for c in ("tree", "hi", "lo", "bits", "node"))
    place = TaskContext.get().partitionId()
    # Both ends count as open: whether the next range goes on is found afterwards.
    for a, b in neighbours(tree, hi, lo, bits, node, True, True):
        if len(a):
            yield pd.DataFrame({"a": a, "b": b, "place": -1, "tree": 0, "hi": 0})
    ends = [0, len(rows) - 1]
    yield pd.DataFrame({"a": node[ends], "b": [0, 1], "place": place, "tree": tree[ends], "hi": hi[ends]})


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of `sets` (node, keys, bits) that some tree brings together."""
    numbers = F.sequence(F.lit(0), F.lit(TREES - 1))
    key = lambda place: F.get("keys", 2 * F.col("tree") + place)
    rows = sets.select("node", "keys", "bits", F.explode(numbers).alias("tree")).select("tree", key(0).alias("hi"), key(1).alias("lo"), "bits", "node")
    spark = sets.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sets.count() * TREES / ROWS))
    order = ["tree", "hi", "lo", "node"]
    found = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_tree, "a long, b long, place int, tree int, hi long")
    found = materialise(found, "forest")
    # A run that goes on in the next range: its last row here and its first one there.
    ends = found.where("place >= 0")
    last, first = ends.where("b = 1").alias("l"), ends.where("b = 0").withColumnRenamed("a", "f").alias("r")
    across = last.join(first, F.expr("l.place + 1 = r.place and l.tree = r.tree and l.hi = r.hi")).select("a", F.col("f").alias("b"))
    return found.where("place < 0").select("a", "b").unionByName(across)


# Exact comparison


def linked(sets: list[np.ndarray], left: int, percent: int) -> np.ndarray:
    """Number of a linked earlier set (or its own) for each set, so that linked sets hang together.

    Sets before `left` are compared with those from `left` on; if that is 0, all with all. Sets that already hang
    together are not compared again.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    group = np.arange(len(sets))
    mark = np.zeros(int(codes.max()) + 1, dtype=bool)
    for x in range(left or len(sets) - 1):
        own = codes[starts[x] : starts[x] + sizes[x]]
        others = np.arange(left or x + 1, len(sets))
        small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[(group[others] != group[x]) & (100 * small >= percent * large)]
        if not len(others):
            continue
        mark[own] = True
        if others[-1] - others[0] + 1 == len(others):
            meant = codes[starts[others[0]] : starts[others[-1]] + sizes[others[-1]]]
            offsets = starts[others] - starts[others[0]]
        else:
            meant = np.concatenate([codes[starts[y] : starts[y] + sizes[y]] for y in others])
            offsets = np.cumsum(sizes[others]) - sizes[others]
        common = np.add.reduceat(mark[meant], offsets, dtype=np.int64)
        mark[own] = False
        hits = others[100 * common >= percent * (sizes[x] + sizes[others] - common)]
        if len(hits):
            joined = np.unique(group[np.append(hits, x)])
            group[np.isin(group, joined)] = joined[0]
    return group


def _compare(size: int, percent: int) -> Callable:
    """Links (a, b) that hold together the sets of each block pair; rows come by cluster and pair, then side and node."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> pd.DataFrame:
            left = sides.count(0) if 1 in sides else 0
            group = linked(sets, left, percent)
            hung = np.flatnonzero(group != np.arange(len(group)))
            ids = np.array(nodes)
            return pd.DataFrame({"a": ids[group[hung]], "b": ids[hung], "whole": whole})

        pair, whole, nodes, sides, sets = None, True, [], [], []
        for batch in batches:
            for cluster, one, two, blocks, side, node, hashes in zip(
                batch.cluster, batch.one, batch.two, batch.blocks, batch.side, batch.node, shingle_hashes(batch.text, size, 42), strict=True
            ):
                if (cluster, one, two) != pair:
                    if len(sets) > 1:
                        yield found()
                    pair, whole, nodes, sides, sets = (cluster, one, two), blocks == 1, [], [], []
                if nodes and nodes[-1] == node:  # a repeated row
                    continue
                nodes.append(node)
                sides.append(side)
                sets.append(np.unique(hashes))
        if len(sets) > 1:
            yield found()

    return links


def label(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept.

    Documents link if their sets of `size`-word shingles share at least `percent` in a hundred of their union; links
    are confirmed on whole sets of 64-bit hashes. Equal sets are linked without a search. Null texts and texts without
    words have an empty set and link with nothing. Rows with a null id take part; a component of null ids only has a
    null id, and `kept` is doc_id = component_id where nulls are equal. Repeated rows give repeated rows, other columns
    are ignored, and an empty table gives none.
    """
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256))
    marked = materialise(docs.select("doc_id", key.alias("key"), marks("text", size).alias("m")).select("doc_id", "key", "m.*"), "signatures")
    # One row for each distinct set, with one row of `docs` to read its text from, and a short number once written.
    grouped = marked.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("n").alias("n"), F.count("*").alias("rows"))
    sets = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "sets")

    clusters = components(candidates(sets.select("node", "keys", "bits"))).withColumnRenamed("root", "cluster")
    members = sets.select("node", "key", "n").join(clusters, "node")
    members = materialise(members, "members")
    sums = members.groupBy("cluster").agg((F.count("*") * F.sum("n")).alias("work"), F.sum("n").alias("hashes"), F.count("*").alias("sets"))
    blocks = F.least("sets", F.greatest(F.ceil(F.sqrt(F.col("work") / WORK)), F.ceil(F.col("hashes") / HASHES), F.lit(1))).cast("int")
    large = materialise(sums.select("cluster", blocks.alias("blocks")).where("blocks > 1"), "large-clusters")
    few = large.count() <= SMALL_CLUSTERS
    placed = members.join(F.broadcast(large) if few else large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select(key.alias("key"), "text").join(placed.select("key", "node", "cluster", "blocks", "block"), "key")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "blocks", (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "text"
    )
    met = dealt.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two", "side", "node")
    links = materialise(met.mapInPandas(_compare(size, percent), "a long, b long, whole boolean"), "links")

    # A cluster of one block is done: its links are stars around the first set of each component.
    done = links.where("whole")
    roots = done.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(done.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    roots = roots.unionByName(components(links.where("not whole")))
    tops = sets.select("digest", "least", "rows", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = materialise(tops, "roots")
    smallest = tops.groupBy("root").agg(F.min("least").alias("new"))
    mapping = tops.join(smallest, "root").select(F.col("digest").alias("old"), "new", F.col("rows").alias("n"))
    count = sets.count()
    named = map_back(marked.select("doc_id", "n", "digest"), F.col("digest"), mapping, marked.count(), count <= SMALL_SETS, "found")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
