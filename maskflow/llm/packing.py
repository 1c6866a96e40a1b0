"""Packing of tokenised documents: deficit round-robin over source queues fills every window to target proportions."""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import ship
from maskflow.session import materialise

ship(__name__)

SPECIAL = {"<|endoftext|>": 50256}  # fixed value of the vocabulary


@dataclass(frozen=True)
class Settings:
    window: int = 2048  # tokens of a sequence; a power of two
    end_id: int = 1  # stands after every document
    grant: int = 128  # a source sends when it may send this much, or the rest of a document
    part_tokens: int = 1 << 20  # tokens that one task packs, on average
    chain: int = 1024  # parts over which deficits are carried


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks: bytes):
    """Byte-level BPE of the 50k vocabulary; the same ids as the tokenizer file of that name, several times faster."""
    import public_tokenizers
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=SPECIAL)


def tokenise(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """row, doc_id (as text), source, n and ids (16 bits each, little endian) of every document, written once."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(vocabulary or vocabulary_path(), "rb") as file:
            coder = encoder(file.read())
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for at in range(0, len(batch), 256):  # texts may be long
                part = batch.iloc[at : at + 256]
                ids = [np.concatenate([coder.encode_to_numpy(t or "", allowed_special="all"), end]).astype("<u2") for t in part.text]
                yield pd.DataFrame(
                    {"row": part.row, "doc_id": part.doc_id, "source": part.source, "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}
                )

    wanted = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.col("text"),
    )
    return materialise(wanted.mapInPandas(encoded, "row long, doc_id string, source string, n long, ids binary"), "tokens")


def plan_parts(tokens: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """`tokens` with the part that packs them, and per part and source its target share and carried deficit.

    Rows are dealt to parts by a hash, so that each part has about the mixture of all; what the parts before in its
    chain have sent of a source, less than its share, is the deficit a part starts with.
    """
    total = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // settings.part_tokens))
    dealt = tokens.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    sums = materialise(dealt.groupBy("part", "source").agg(F.sum("n").alias("n")), "sums")
    shares = sums.groupBy("source").agg((F.sum("n") / F.lit(max(1, total))).alias("share"))
    chain = F.floor(F.col("part") / settings.chain)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sent = sums.withColumn("own", F.coalesce(F.sum("n").over(before.partitionBy(chain, "source")), F.lit(0)))
    whole = sums.groupBy("part").agg(F.sum("n").alias("all"))
    whole = whole.withColumn("all", F.coalesce(F.sum("all").over(before.partitionBy(chain)), F.lit(0)))
    carried = sent.join(whole, "part").join(shares, "source")
    return dealt, carried.select("part", "source", "share", (F.col("share") * F.col("all") - F.col("own")).alias("carry"))


def fill(docs: list[tuple[int, str, int]], targets: dict[str, tuple[float, float]], settings: Settings) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; `docs` are (index, source, tokens).

    Windows are full; what is left at the end goes into windows of falling powers of two, so that nothing is padded.
    """
    queues: dict[str, deque] = {}
    for index, source, n in docs:
        queues.setdefault(source, deque()).append([index, 0, n])
    deficit = {s: targets[s][1] for s in queues}
    left, sequence, turn = sum(n for _, _, n in docs), 0, 0
    while left:
        space = settings.window if left >= settings.window else 1 << (left.bit_length() - 1)
        left, offset = left - space, 0
        live = sorted(queues)
        mass = sum(targets[s][0] for s in live) or 1.0
        for s in live:
            deficit[s] += space * targets[s][0] / mass
        turn += 1
        order = live[turn % len(live) :] + live[: turn % len(live)]
        while space:
            sent = False
            for s in order:
                while space and s in queues:
                    head = queues[s][0]
                    rest = head[2] - head[1]
                    if deficit[s] < min(settings.grant, rest, space):
                        break
                    length = min(rest, space, int(deficit[s]))
                    yield head[0], head[1], length, sequence, offset
                    sent = True
                    head[1] += length
                    offset, space, deficit[s] = offset + length, space - length, deficit[s] - length
                    if head[1] == head[2]:
                        queues[s].popleft()
                        if not queues[s]:
                            del queues[s]
            if space and not sent:  # nobody may send: the one that lacks most goes first
                s = max((s for s in order if s in queues), key=deficit.__getitem__)
                head = queues[s][0]
                deficit[s] += max(0.0, min(settings.grant, head[2] - head[1], space) - deficit[s])
        sequence += 1


def pack(docs: DataFrame, settings: Settings = Settings(), vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are their end id alone. Null sources are one source, the empty one. Repeated rows and null
    ids are packed like others; an empty table gives no rows. Sequences hold `window` tokens, or a smaller power of
    two at the end of a part. `with_ids` adds the ids of each piece as little-endian 16-bit numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens, carried = plan_parts(tokenise(docs, vocabulary, settings.end_id), settings)

    def packed(group: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        ids = [np.frombuffer(b, dtype="<u2") for b in group.ids]
        aims = {s: (a, c) for s, a, c in zip(targets.source, targets.share, targets.carry, strict=True)}
        rows = list(fill(list(zip(range(len(group)), group.source, group.n, strict=True)), aims, settings))
        index, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
        pieces = [ids[i][a : a + n] for i, a, n in zip(index.tolist(), start.tolist(), length.tolist(), strict=True)]
        found = pd.DataFrame(
            {
                "doc_id": group.doc_id.to_numpy()[index],
                "source": group.source.to_numpy()[index],
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(p.astype("<u4").tobytes()) for p in pieces],
                "doc_tokens": group.n.to_numpy()[index],
                "sequence_id": (np.int64(group.part.iloc[0]) << 32) + sequence,
                "offset": offset,
            }
        )
        if with_ids:
            found["ids"] = [p.tobytes() for p in pieces]
        return found

    fields = "doc_id string, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = tokens.groupBy("part").cogroup(carried.groupBy("part")).applyInPandas(packed, fields + (", ids binary" if with_ids else ""))
    return pieces.withColumn("doc_id", F.col("doc_id").cast(kind))
