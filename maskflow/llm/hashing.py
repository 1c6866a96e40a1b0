"""XXH64 of very many short byte strings at once: word shingles of whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

from maskflow.llm.common import ship, words_of

ship(__name__)

# Fixed values of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5

CHUNK = 65536  # strings that are hashed at once
LONG = 256  # bytes from which on a string is hashed by itself


def _u(value: int) -> np.uint64:
    return np.uint64(value & 0xFFFFFFFFFFFFFFFF)


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mix(state: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(state + lane * _u(P2), 31) * _u(P1)


def _hash_sorted(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of strings in order of length, so that the ones with another lane to read are always the last ones."""
    lanes = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = np.full(len(starts), _u(seed + P5), dtype=np.uint64)
    at = starts.copy()
    first = int(np.searchsorted(lengths, 32))
    if first < len(starts):
        state = [np.full(len(starts) - first, _u(v), dtype=np.uint64) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        for stripe in range(1, int(lengths[-1]) // 32 + 1):
            more = int(np.searchsorted(lengths, 32 * stripe))
            for number, v in enumerate(state):
                v[more - first :] = _mix(v[more - first :], lanes[at[more:] + 8 * number])
            at[more:] += 32
        merged = _turn(state[0], 1) + _turn(state[1], 7) + _turn(state[2], 12) + _turn(state[3], 18)
        for v in state:
            merged = (merged ^ _mix(np.uint64(0), v)) * _u(P1) + _u(P4)
        h[first:] = merged
    h += lengths.astype(np.uint64)
    rest = lengths & 31
    for lane in range(1, 4):
        rows = np.flatnonzero(rest >= 8 * lane)
        h[rows] = _turn(h[rows] ^ _mix(np.uint64(0), lanes[at[rows]]), 27) * _u(P1) + _u(P4)
        at[rows] += 8
    rows = np.flatnonzero(rest & 4)
    h[rows] = _turn(h[rows] ^ (lanes[at[rows]] & np.uint64(0xFFFFFFFF)) * _u(P1), 23) * _u(P2) + _u(P3)
    at[rows] += 4
    for byte in range(1, 4):
        rows = np.flatnonzero((rest & 3) >= byte)
        h[rows] = _turn(h[rows] ^ data[at[rows]].astype(np.uint64) * _u(P5), 11) * _u(P1)
        at[rows] += 1
    h = (h ^ (h >> np.uint64(33))) * _u(P2)
    h = (h ^ (h >> np.uint64(29))) * _u(P3)
    return h ^ (h >> np.uint64(32))


def xxh64(joined: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of joined[start:end] for each pair."""
    data = np.frombuffer(joined + bytes(8), dtype=np.uint8)
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), CHUNK):
        lengths = ends[at : at + CHUNK] - starts[at : at + CHUNK]
        order = np.argsort(np.minimum(lengths, LONG).astype(np.uint16), kind="stable")
        short = order[: int(np.count_nonzero(lengths < LONG))]
        if len(short):
            out[at + short] = _hash_sorted(data, starts[at + short], lengths[short], seed)
        for row in (at + order[len(short) :]).tolist():
            out[row] = xxhash.xxh64_intdigest(joined[starts[row] : ends[row]], seed)
    return out


def shingle_places(words: list[bytes], size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The space-joined words, and where each shingle starts and ends; fewer words than `size` are one shingle."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if 0 < len(words) < size:
        return b" ".join(words), starts[:1], ends[-1:]
    return b" ".join(words), starts[: max(0, len(words) - size + 1)], ends[size - 1 :]


def shingle_hashes(texts: Iterable[str | None], size: int, seed: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles, repeats included, in order; none without words."""

    def flush() -> Iterator[np.ndarray]:
        shift = np.cumsum([0] + [len(p[0]) for p in pending[:-1]])
        starts = np.concatenate([p[1] + s for p, s in zip(pending, shift, strict=True)])
        ends = np.concatenate([p[2] + s for p, s in zip(pending, shift, strict=True)])
        h = xxh64(b"".join(p[0] for p in pending), starts, ends, seed)
        yield from np.split(h, np.cumsum([len(p[1]) for p in pending])[:-1])

    pending, count = [], 0
    for text in texts:
        pending.append(shingle_places(words_of(text), size))
        count += len(pending[-1][1])
        if count >= CHUNK or len(pending) >= CHUNK:
            yield from flush()
            pending, count = [], 0
    if pending:
        yield from flush()
