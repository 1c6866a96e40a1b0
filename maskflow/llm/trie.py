"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt to shards of neighbouring ids. A shard indexes (position, turn) to the bitset of its
conversations; going down from the root, a parent's bitset intersected with the postings of the next position gives the
children, popcounts give their sizes, and the bitset of conversations of that length gives who ends there. Nodes of
different shards meet by a hash of their path. Only nodes that several shards hold need more than adding up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import ship
from maskflow.operators.hotjoin import map_back
from maskflow.session import materialise

ship(__name__)

BLOCK = 100  # conversations that begin like the first of them
TURNS = 6  # of its turns they take over, from 0 to one less
SHARD = 500  # conversation ids in a shard, whole blocks
SMALL_NODES = 100_000  # up to so many nodes the map of parents is broadcast, 24 bytes each

NODES = (
    "key binary, parent binary, depth long, conv_id long, n_convs long, chars long, total long, once long, leaves long, "
    "childless long, shard long, ends array<long>"
)


def block_of(conv_id: Column) -> Column:
    return conv_id - conv_id % BLOCK


def turn_code(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn; the length keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def taken_over(conv_id: Column) -> Column:
    """How many of its block's first turns a conversation begins with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % TURNS


def rebuilt(ids: np.ndarray, taken: np.ndarray, codes: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Each conversation of a shard with its turns, after the block's first turns took the place of as many of its own.

    Rows come by conversation and in order of turns.
    """
    cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if len(ids) else 0))
    spans = {int(ids[at]): (int(at), int(end)) for at, end in zip(cuts, [*cuts[1:], len(ids)], strict=True)}
    convs, turns = [], []
    for conv, (at, end) in spans.items():
        first, last = spans.get(conv - int(np.fmod(conv, BLOCK)), (0, 0))
        h = int(taken[at])
        convs.append(conv)
        turns.append([*codes[first : min(first + h, last)], *codes[at + h : end]])
    return convs, turns


def shard_nodes(convs: list[int], turns: list[list[bytes]], chars: dict[bytes, int]) -> dict[str, list]:
    """The trie of a shard, parents before children; `convs` ascend.

    total and once add up, over the subtree, the code points of each node's last text: by member and once per node.
    """
    postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, turns), default=0))]
    ending: dict[int, int] = {}
    for i, codes in enumerate(turns):
        ending[len(codes)] = ending.get(len(codes), 0) | 1 << i
        for posting, code in zip(postings, codes, strict=False):
            posting[code] = posting.get(code, 0) | 1 << i
    names = ["key", "parent", "depth", "conv_id", "n_convs", "chars", "total", "once", "leaves", "childless", "ends"]
    out: dict[str, list] = {name: [] for name in names}
    above: list[int] = []
    todo = [((1 << len(convs)) - 1, 0, bytes(16), None, -1, 0)]
    while todo:
        members, depth, key, parent, at, size = todo.pop()
        count = members.bit_count()
        ends = members & ending.get(depth, 0)
        rest = members ^ ends
        place = len(above)
        above.append(at)
        row = (key, parent, depth, convs[(members & -members).bit_length() - 1], count, size, count * size, size, int(not rest), int(not rest))
        for name, value in zip(names, row, strict=False):
            out[name].append(value)
        listed = []
        while ends:
            listed.append(convs[(ends & -ends).bit_length() - 1])
            ends &= ends - 1
        out["ends"].append(listed)
        while rest:
            code = turns[(rest & -rest).bit_length() - 1][depth]
            child = members & postings[depth][code]
            rest &= ~child
            todo.append((child, depth + 1, hashlib.md5(key + code).digest(), key, place, chars[code]))
    for place in range(len(above) - 1, 0, -1):
        for name in ("total", "once", "leaves"):
            out[name][above[place]] += out[name][place]
    return out


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of one shard after the other; rows come by shard."""

    def built(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True)
        codes = rows.code.map(bytes).to_numpy(dtype=object)
        convs, turns = rebuilt(rows.conv_id.to_numpy(), rows.taken.to_numpy(), codes)
        return pd.DataFrame(shard_nodes(convs, turns, dict(zip(codes, rows.chars.tolist(), strict=True)))).assign(shard=rows.shard.iat[0])[columns]

    columns = [c.split()[0] for c in NODES.split(", ")]
    parts: list[pd.DataFrame] = []
    for batch in batches:
        for shard, rows in batch.groupby("shard", sort=True):
            if parts and parts[0].shard.iat[0] != shard:
                yield built(parts)
                parts = []
            parts.append(rows)
    if parts:
        yield built(parts)


def _ends_hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's ending conversations; rows come by node and shard, one list is held at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for node, ends in zip(batch.key, batch.ends, strict=True):
            listed = ",".join(map(str, ends.tolist())).encode()
            if bytes(node) == key:
                state.update(b"," + listed)
                continue
            if key is not None:
                done.append((key, state.hexdigest()))
            key, state = bytes(node), hashlib.sha256(listed)
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])


def below(nodes: DataFrame, deepest: int) -> DataFrame:
    """`nodes` (key, parent, depth, leaves, once) with leaves and once summed over the subtree.

    After round k a node holds the sum over descendants nearer than 2^k and knows its ancestor at that distance, so
    that the rounds grow with the logarithm of the depth and every round has one row a node.
    """
    state, reach = nodes.withColumnRenamed("parent", "up"), 1
    while reach <= deepest:
        sent = state.where(F.col("depth") >= reach).groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("once").alias("o"))
        added = state.join(sent, "key", "left").select("key", "depth", "up", F.expr("leaves + coalesce(l, 0)").alias("leaves"), F.expr("once + coalesce(o, 0)").alias("once"))
        higher = state.where(F.col("depth") >= reach).select(F.col("key").alias("up"), F.col("up").alias("higher"))
        # Only nodes twice as deep have an ancestor twice as far, and that hides the root, which all shallow ones share.
        asked = F.when(F.col("depth") >= 2 * reach, F.col("up")).alias("up")
        state = added.select("key", "depth", asked, "leaves", "once").join(higher, "up", "left").select("key", "depth", F.col("higher").alias("up"), "leaves", "once")
        state = materialise(state, "subtrees")
        reach *= 2
    return state.select("key", F.col("leaves").alias("more_leaves"), F.col("once").alias("more_once"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id (null for
    the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by `turn`, nulls first; turns that tie by role, then by the hash of the text, so that repeated
    rows are repeated turns. Null role and text are empty. Rows without conv_id belong to no conversation and are left
    out; other columns are ignored. An empty table gives no rows, not even a root. A conversation is read by one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), turn_code(role, text).alias("code"), F.char_length(text).cast("long").alias("chars")
    )
    turns = turns.withColumns({"shard": F.floor(block_of(F.col("conv_id")) / SHARD).cast("long"), "taken": taken_over(F.col("conv_id"))})
    dealt = turns.repartition("shard").sortWithinPartitions("shard", "conv_id", F.asc_nulls_first("at"), "role", "code")
    parts = materialise(dealt.select("shard", "conv_id", "taken", "code", "chars").mapInPandas(_shards, NODES), "trie-shards")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "total", "once", "leaves", "childless")]
    nodes = parts.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars"), F.count("*").alias("shards"), *sums)
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, "key", "left").na.fill(0, ["n_children"]), "trie-nodes")

    # A node of several shards was counted in each: set that right in its own row, then in all rows above it.
    shared = nodes.where("shards > 1").select(
        "key", "parent", "depth", F.expr("cast(n_children = 0 as long) - childless").alias("leaves"), F.expr("(1 - shards) * chars").alias("once")
    )
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    right = nodes.join(below(shared, deepest), "key", "left").na.fill(0, ["more_leaves", "more_once"])

    ends = parts.where(F.size("ends") > 0).select("key", "shard", "ends")
    hashes = ends.repartition("key").sortWithinPartitions("key", "shard").select("key", "ends").mapInPandas(_ends_hash, "key binary, ends_sha256 string")
    full = right.join(hashes, "key", "left").select(
        "parent", "conv_id", "depth", "n_convs", "n_children", F.expr("leaves + more_leaves").alias("n_leaves"),
        F.expr("total - once - more_once").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    count = nodes.count()
    parents = nodes.where("n_children > 0").select(F.col("key").alias("old"), F.col("conv_id").alias("new"), F.col("n_children").alias("n"))
    named = map_back(full, F.col("parent"), parents, count, count <= SMALL_NODES, "parent_conv_id")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
