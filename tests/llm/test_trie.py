"""The conversation trie against a plain version."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from maskflow.llm import trie
from maskflow.llm.queries import llm_queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, shard string, depth int"


def code(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", code(r[2] or "", r[3] or ""), r[3] or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(path)))
        up = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), up, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, llm_queries()["op11_conversation_trie"](spark, sf_dir).collect()), key=str) == plain(rows)


@pytest.fixture(scope="module")
def odd_rows():
    rows = [
        (None, 1, "user", "no conversation"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "assistant", "b"),
        (1, 2, "user", ""), (7, 0, "", "user"), (8, 0, "user", ""), (9, 3, None, "é𝄞ß"), (9, 2, "user", "x" * 50_000), (-5, 0, "user", "minus"),
        (-150, 0, "user", "minus"), (-150, 1, "user", "minus"), (2**62, 0, "user", "far"), (5_000_017, 0, "user", "no base"),
    ]
    # Long conversations that shards share and leave at different depths, and a hot one in every shard.
    for c, length in [(600, 70), (1200, 70), (1800, 33), (2400, 71)]:
        rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t}" if t < 70 else f"own {c}") for t in range(length)]
    rows += [(c, t, "user", f"hot {t}") for c in range(3000, 9000, 100) for t in range(c // 1000)]
    return [(*r, "k", "s", 3) for r in rows]


def test_trie_of_odd_rows(spark, odd_rows):
    got = trie.trie(spark.createDataFrame(odd_rows, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == plain(odd_rows)
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parents_beyond_the_broadcast(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(trie, "SMALL_NODES", 0)
    got = trie.trie(spark.createDataFrame(odd_rows, SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == plain(odd_rows)


def test_equal_paths_of_different_turns_stay_apart():
    convs, turns = [1, 2], [[b"a" * 16, b"b" * 16], [b"b" * 16, b"a" * 16]]
    found = trie.shard_nodes(convs, turns, {b"a" * 16: 3, b"b" * 16: 4})
    assert len(set(found["key"])) == 5 and found["leaves"][0] == 2 and found["once"][0] == 14
