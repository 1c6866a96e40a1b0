"""SimHash near-duplicates: fingerprints of word shingles, joined on grids of per-segment bit counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import ship
from maskflow.llm.components import components
from maskflow.llm.hashing import CHUNK, shingle_hashes
from maskflow.session import materialise

ship(__name__)

# Segments are two bits wide: 32 of them, with 0 to 2 bits set each, dealt to six groups.
SEGMENT = 0x5555555555555555
GROUPS = 6
BLOCK = 1024  # rows that are compared at once
LARGE = 4096  # buckets above this size are cut further before rows are compared
SAMPLE = 512  # about so many rows of a larger cell, of which its representatives are chosen
CHOSEN = 16  # representatives of a larger cell at most
SMALL = 8  # buckets up to this size are compared all at once, by their distance in the sorted rows


# Fingerprints


def majority(hashes: np.ndarray) -> int:
    """Bit set if it is set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8))
        bits = np.concatenate([bits, np.zeros(-len(bits) % (64 * 255), dtype=np.uint8)]).reshape(-1, 255, 64)
        counts += bits.sum(1, dtype=np.uint8).sum(0, dtype=np.int64)  # 255 ones fit into a byte
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprint(text: str | Column, size: int = 3, seed: int = 42) -> Column:
    """64-bit SimHash of a text as a signed long; null and blank texts give 0."""

    @F.pandas_udf("long")
    def computed(texts: pd.Series) -> pd.Series:
        found = np.array([majority(h) for h in shingle_hashes(texts, size, seed)], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    return computed(F.col(text) if isinstance(text, str) else text)


def hex_digits(value: str) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# Grid


def segment_counts(value: str) -> Column:
    """The 32 bit counts, packed two bits each, by bit operations only."""
    low = F.col(value).bitwiseAND(F.lit(SEGMENT))
    high = F.shiftrightunsigned(value, 1).bitwiseAND(F.lit(SEGMENT))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_cells(counts: str) -> Column:
    """One cell for each choice of three of the six groups: their bit counts.

    Fingerprints within 3 bits have counts within Manhattan distance 3, so that at most three groups differ and the
    counts of three others are equal: every such pair shares a cell.
    """
    masks = []
    for group in range(GROUPS):
        bits = sum(3 << (2 * segment) for segment in range(group, 32, GROUPS))
        masks.append(bits)
    cells = []
    for number, chosen in enumerate(combinations(range(GROUPS), 3)):
        mask = sum(masks[g] for g in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        cells.append(F.xxhash64(F.lit(number), F.col(counts).bitwiseAND(F.lit(signed))))
    return F.array(*cells)


# Links within a cell


def _within(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs (one row of x, one of y) that differ in at most `radius` bits; rows are words of 64 bits."""
    bound = np.zeros((len(x), len(y)), dtype=np.int16)
    for column in range(x.shape[1]):  # the whole words' bit counts: Manhattan distance of the coarsest segments
        one, other = np.bitwise_count(x[:, column]).astype(np.int16), np.bitwise_count(y[:, column]).astype(np.int16)
        bound += np.abs(one[:, None] - other[None, :])
    i, j = np.nonzero(bound <= radius)
    apart = np.zeros(len(i), dtype=np.int32)
    for column in range(x.shape[1]):
        apart += np.bitwise_count(x[i, column] ^ y[j, column])
    near = apart <= radius
    return i[near], j[near]


def _hang(parent: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """`parent` (each row's smallest known companion) after these links; every round hooks roots under smaller ones."""
    while True:
        a, b = parent[rows], parent[others]
        open_ = a != b
        if not open_.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _compare(bits: np.ndarray, rows: np.ndarray, radius: int, parent: np.ndarray) -> np.ndarray:
    for at in range(0, len(rows), BLOCK):
        for to in range(at, len(rows), BLOCK):
            left, right = rows[at : at + BLOCK], rows[to : to + BLOCK]
            i, j = _within(bits[left], bits[right], radius)
            parent = _hang(parent, left[i], right[j])
    return parent


def cluster(bits: np.ndarray, radius: int, split: int = 0) -> np.ndarray:
    """For each row the first row that it is linked with, over any number of links; without listing the links.

    With `split`, only the rows before it are compared with those from it on.

    A large bucket of single-word rows is cut by the four 16-bit quarters first: with at most 3 differing bits one
    quarter is equal, so that nothing is lost.
    """
    parent = np.arange(len(bits))
    if split:
        for at in range(0, split, BLOCK):
            for to in range(split, len(bits), BLOCK):
                left, right = np.arange(at, min(at + BLOCK, split)), np.arange(to, min(to + BLOCK, len(bits)))
                i, j = _within(bits[left], bits[right], radius)
                parent = _hang(parent, left[i], right[j])
        return parent
    if len(bits) > LARGE and bits.shape[1] == 1 and radius <= 3:
        for quarter in range(4):
            value = (bits[:, 0] >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
            order = np.argsort(value, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                if len(rows) > 1:
                    parent = _compare(bits, rows, radius, parent)
        return parent
    return _compare(bits, parent.copy(), radius, parent)


def _words(bits) -> np.ndarray:
    return np.frombuffer(b"".join(bits), dtype=">u8").astype(np.uint64).reshape(len(bits), -1)


def _distances(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Differing bits of each row to one other row."""
    return np.bitwise_count(words ^ other).sum(1, dtype=np.int64)


def _within_cells(cells: DataFrame, radius: int) -> DataFrame:
    """Links of cells of at most LARGE fingerprints.

    Rows are sorted by cell within the shuffled partitions and read as a stream, so that a task holds one cell at a
    time. A cell of n fingerprints gives n - 1 links at most, never all pairs (at most SMALL: the links there are).
    """

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(cell: np.ndarray, bits: np.ndarray) -> pd.DataFrame:
            words = _words(bits)
            starts = np.append(0, np.flatnonzero(cell[1:] != cell[:-1]) + 1)
            sizes = np.diff(np.append(starts, len(cell)))
            rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
            moved, kept = [], []
            for step in range(1, SMALL):
                left, right = rows[:-step], rows[step:]
                same = cell[left] == cell[right]
                left, right = left[same], right[same]
                if not len(left):
                    break
                near = np.bitwise_count(words[left] ^ words[right]).sum(1, dtype=np.int64) <= radius
                moved.append(right[near])
                kept.append(left[near])
            for at in np.flatnonzero(sizes > SMALL).tolist():
                first = cluster(words[starts[at] : starts[at] + sizes[at]], radius)
                hung = np.flatnonzero(first != np.arange(len(first)))
                moved.append(starts[at] + hung)
                kept.append(starts[at] + first[hung])
            if not moved:
                return pd.DataFrame({"a": [], "b": []})
            return pd.DataFrame({"a": bits[np.concatenate(moved)], "b": bits[np.concatenate(kept)]})

        cell, bits = np.array([], dtype=np.int64), np.array([], dtype=object)
        for batch in batches:
            cell, bits = np.concatenate([cell, batch.cell.to_numpy()]), np.concatenate([bits, batch.bits.to_numpy()])
            last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # may go on in the next batch
            if last:
                yield of(cell[:last], bits[:last])
            cell, bits = cell[last:], bits[last:]
        if len(bits) > 1:
            yield of(cell, bits)

    dealt = cells.select("cell", "bits").repartition("cell").sortWithinPartitions("cell", "bits")
    return dealt.mapInPandas(linked, "a binary, b binary")


def representatives(bits: list[bytes], radius: int) -> list[bytes]:
    """At most CHOSEN rows of a sample of a cell: each time the one with most rows within the radius that no other has."""
    words = _words(bits)
    near = np.array([_distances(words, w) <= radius for w in words])
    open_, chosen = np.ones(len(bits), dtype=bool), []
    while len(chosen) < CHOSEN:
        gain = (near & open_).sum(1)
        best = int(np.argmax(gain))
        if gain[best] < 2:  # it would hold itself only
            break
        chosen.append(bits[best])
        open_ &= ~near[best]
    return chosen


def _between_blocks(cells: DataFrame, radius: int) -> DataFrame:
    """Links of cells of any size: `cells` has cell, bits and n, the fingerprints of the cell.

    Rows within the radius of a representative hang on it, and representatives that share a row are one group: rows of
    a group need no comparison. The rest is compared by pairs of blocks of about LARGE rows, each pair a group of its
    own: rows on no representative with each other and, if within twice the radius of a representative (else no row on
    one can be near), with all groups; groups with each other. Dense cells shrink to little; a cell whose rows are all
    far apart takes the square of its blocks, dealt over all tasks.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": rows.cell[:1], "chosen": [representatives(sorted(rows.bits), radius)]})

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            words, held, close, first = _words(rows.bits) if len(rows) else None, np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=bool), np.full(len(rows), None, dtype=object)
            for at in rows.groupby("cell").indices.values():
                for number, bits in enumerate(() if rows.chosen.iat[at[0]] is None else rows.chosen.iat[at[0]]):
                    apart = _distances(words[at], _words([bits])[0])
                    new = at[(apart <= radius) & (held[at] == 0)]
                    first[new] = np.array([bits], dtype=object)
                    held[at[apart <= radius]] |= 1 << number
                    close[at] |= apart <= 2 * radius
            yield pd.DataFrame({"cell": rows.cell, "bits": rows.bits, "held": held, "close": close, "first": first})

    def merge(masks: pd.DataFrame) -> pd.DataFrame:
        """The group of each set of representatives that some row is near to: the first one of all linked with it."""
        parent = np.arange(CHOSEN)
        sets = [[k for k in range(CHOSEN) if held >> k & 1] for held in masks.held]
        for s in sets:
            parent = _hang(parent, np.full(len(s), s[0]), np.array(s))
        others = [[masks.chosen.iat[0][k] for k in s] for s in sets]
        return pd.DataFrame({"cell": masks.cell, "held": masks.held, "part": [int(parent[s[0]]) for s in sets], "others": others})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["right", "bits"], kind="stable")
        bits = rows.bits.to_numpy()
        split = int((~rows.right).sum())
        first = cluster(_words(bits), radius, 0 if split == len(bits) else split)
        hung = np.flatnonzero(first != np.arange(len(first)))
        return pd.DataFrame({"a": bits[hung], "b": bits[first[hung]]})

    drawn = cells.where(F.pmod(F.xxhash64(F.lit("sample"), "bits"), F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE))) == 0)
    chosen = materialise(drawn.select("cell", "bits").groupBy("cell").applyInPandas(choose, "cell long, chosen array<binary>"), "representatives")
    asked = cells.select("cell", "bits").join(F.broadcast(chosen), "cell", "left")
    marked = materialise(asked.mapInPandas(mark, "cell long, bits binary, held long, close boolean, first binary"), "marked")

    sets = marked.where("held <> 0").select("cell", "held").distinct().join(F.broadcast(chosen), "cell")
    sets = materialise(sets.groupBy("cell").applyInPandas(merge, "cell long, held long, part int, others array<binary>"), "groups")
    apart = F.when(F.col("close"), -1).otherwise(-2)
    parts = marked.join(F.broadcast(sets.drop("others")), ["cell", "held"], "left").withColumn("part", F.coalesce("part", apart))
    sizes = parts.groupBy("cell", "part").agg(F.ceil(F.count("*") / LARGE).cast("int").alias("blocks"))
    sizes = materialise(sizes, "blocks")
    block = F.pmod(F.xxhash64(F.lit("block"), "bits"), F.col("blocks")).cast("int").alias("block")
    rows = parts.join(F.broadcast(sizes), ["cell", "part"]).select("cell", "part", block, "bits")

    blocks = sizes.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    one, two = blocks.select("cell", F.struct("part", "block").alias("x")), blocks.select("cell", F.struct("part", "block").alias("y"))
    of_one_group = (F.col("x.part") >= 0) & (F.col("x.part") == F.col("y.part"))
    too_far = (F.col("x.part") == -2) & (F.col("y.part") >= 0)
    pairs = one.join(two, "cell").where((F.col("x") <= F.col("y")) & ~of_one_group & ~too_far)
    pairs = materialise(pairs, "block-pairs")
    sides = pairs.select("cell", "x", "y", F.col("x.part").alias("part"), F.col("x.block").alias("block"), F.lit(False).alias("right")).unionByName(
        pairs.where("x <> y").select("cell", "x", "y", F.col("y.part").alias("part"), F.col("y.block").alias("block"), F.lit(True).alias("right"))
    )
    met = rows.join(sides, ["cell", "part", "block"]).select("cell", "x", "y", "right", "bits")
    compared = met.groupBy("cell", "x", "y").applyInPandas(compare, "a binary, b binary")
    hung = marked.where("held <> 0 and bits <> first").select(F.col("bits").alias("a"), F.col("first").alias("b"))
    joined = sets.select(F.explode("others").alias("a"), F.col("others")[0].alias("b")).where("a <> b")
    return compared.unionByName(hung).unionByName(joined)


def links(cells: DataFrame, radius: int, cut: bool = False) -> DataFrame:
    """Links (a, b) that hold the fingerprints of each cell together: `cells` has cell and bits (whole words, binary).

    Cells are counted first. Those above LARGE never meet in one task: at a radius of 3 or less they are cut by the
    four quarters of the fingerprint (one is equal, so that nothing is lost), and what stays large is compared by
    pairs of blocks.
    """
    large = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > LARGE)
    large = materialise(large, "large-cells")
    if large.isEmpty():
        return _within_cells(cells, radius)
    rest = _within_cells(cells.join(F.broadcast(large.select("cell")), "cell", "left_anti"), radius)
    above = cells.select("cell", "bits").join(F.broadcast(large), "cell")
    if radius > 3 or cut:
        return rest.unionByName(_between_blocks(above, radius))
    size = F.length("bits") / 4
    quarters = [F.xxhash64("cell", F.lit(k), F.substring("bits", (k * size + 1).cast("int"), size.cast("int"))) for k in range(4)]
    return rest.unionByName(links(above.select(F.explode(F.array(*quarters)).alias("cell"), "bits"), radius, True))


def placed(values: DataFrame, linked: DataFrame) -> DataFrame:
    """`values` (distinct bits and more columns) with `root`, the same for all that hang together over the links."""
    roots = components(linked).withColumnRenamed("node", "bits")
    return values.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def on_grid(values: DataFrame) -> DataFrame:
    """`values` (distinct fingerprints `value` and more columns) with `root`, linked at 3 differing bits or fewer."""
    values = materialise(values.withColumn("bits", F.to_binary(hex_digits("value"), F.lit("hex"))), "values")
    counted = values.withColumn("counts", segment_counts("value"))
    return placed(values, links(counted.select(F.explode(grid_cells("counts")).alias("cell"), "bits"), 3))


def label(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links.

    Fingerprints are linked at 3 differing bits or fewer. Exact copies share a fingerprint, so that links are sought
    among distinct fingerprints only. Null and blank texts have fingerprint 0 and are linked like any other. Rows with
    a null id take part; a component of null ids only has a null id. Repeated rows give repeated rows. An empty table
    gives none.
    """
    marked = materialise(docs.select("doc_id", fingerprint("text", size, seed).alias("value")), "fingerprints")
    tops = on_grid(marked.groupBy("value").agg(F.min("doc_id").alias("least")))
    smallest = tops.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = tops.join(smallest, "root").select("value", "component_id")
    return marked.join(ids, "value", "left").select("doc_id", hex_digits("value").alias("fingerprint"), "component_id")


# Documents alike by a share of their shingles


@dataclass(frozen=True)
class Likeness:
    """How documents are linked by the Jaccard likeness of their shingle sets."""

    shingle: int = 5
    least: float = 0.8
    words: int = 16  # 64-bit words of the wide fingerprint; its Hamming distance measures the likeness
    samples: int = 8  # sampled fingerprints; documents meet where one of them is equal
    drawn: int = 3  # shingles in each: two documents of likeness s meet with 1 - (1 - s^3)^8, 0.997 at 0.8

    @property
    def radius(self) -> int:
        """Differing bits at `least`: the angle between two sets of equal size, as a share of a half turn."""
        return round(64 * self.words * math.acos(2 * self.least / (1 + self.least)) / math.pi)


def mixed(h: np.ndarray, number: int) -> np.ndarray:
    """Another hash of each hash (the finaliser of splitmix64 over a numbered step)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (number + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(hashes: np.ndarray, how: Likeness) -> tuple[bytes, list[int]]:
    """The wide fingerprint of the set of shingles, and the sampled fingerprints as the cells it is sought in."""
    if not len(hashes):
        return bytes(8 * how.words), [0]
    h = np.unique(hashes)
    wide = b"".join(majority(mixed(h, w)).to_bytes(8, "big") for w in range(how.words))
    drawn = [h[np.argmin(mixed(h, how.words + k))] for k in range(how.samples * how.drawn)]
    cells = []
    for sample in range(how.samples):
        three = np.array(drawn[sample * how.drawn : (sample + 1) * how.drawn], dtype=np.uint64)
        cells.append(xxhash.xxh64_intdigest(mixed(np.sort(three), sample).tobytes(), sample) - (1 << 63))
    return wide, cells


def sketched(text: str | Column, how: Likeness) -> Column:
    """(bits, cells) of a text."""

    @F.pandas_udf("bits binary, cells array<long>")
    def computed(texts: pd.Series) -> pd.DataFrame:
        found = [sketch(h, how) for h in shingle_hashes(texts, how.shingle, 42)]
        return pd.DataFrame({"bits": [f[0] for f in found], "cells": [f[1] for f in found]})

    return computed(F.col(text) if isinstance(text, str) else text)


def deduplicate(docs: DataFrame, how: Likeness = Likeness()) -> DataFrame:
    """One row of `docs` for each group of alike documents, the one with the smallest doc_id; all columns are kept.

    Groups hang together over links of `label` (the grid of fingerprints) and over those of at least `how.least`, which
    such a grid is too narrow for. Null and blank texts are one group. Rows with a null id
    stay only where no row of their group has one. Repeated rows, and rows that agree in doc_id and text, count once.
    """
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))), 256)
    marked = docs.select("doc_id", key.alias("key"), fingerprint("text").alias("value"), sketched("text", how).alias("s"))
    marked = materialise(marked.select("doc_id", "key", "value", "s.*"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    values = materialise(marked.groupBy("bits").agg(F.min(order).alias("least"), F.first("cells").alias("cells")), "values")
    # Wide fingerprints whose documents hang together on the grid are linked with the least of them.
    pairs = materialise(marked.select("value", "bits").distinct(), "pairs")
    near = pairs.join(on_grid(pairs.select("value").distinct()).select("value", "root"), "value").select("root", "bits")
    hung = near.join(near.groupBy("root").agg(F.min("bits").alias("b")), "root").where("bits <> b").select(F.col("bits").alias("a"), "b")
    wide = links(values.select(F.explode(F.array_distinct("cells")).alias("cell"), "bits"), how.radius)
    tops = placed(values.select("bits", "least"), wide.unionByName(hung))
    kept = tops.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("_key"))
    return docs.withColumn("_key", key).join(kept, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
