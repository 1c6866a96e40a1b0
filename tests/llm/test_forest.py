"""The LSH forest against all pairs of whole shingle sets."""

import numpy as np
import pytest

from maskflow.llm import forest

SCHEMA = "doc_id long, text string, key string, node long, n long, digest string, cluster int, block int"


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) of every row, from all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and group[i] != group[j] and 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return sorted(((d, len(s), least.get(g), d == least.get(g)) for (d, _), s, g in zip(rows, sets, group)), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)

    def words(n):
        return [f"w{k}" for k in draw.integers(0, 4000, n)]

    def edited(text, edits):
        text = list(text)
        for at in draw.integers(0, len(text), edits):
            text[at] = f"e{draw.integers(0, 10**9)}"
        return text

    texts, base = [], words(150)
    texts += [edited(base, draw.integers(0, 9)) for _ in range(160)]  # a dense group with rows that link through others only
    for _ in range(40):
        one = words(int(draw.integers(4, 200)))
        texts += [one, edited(one, draw.integers(1, 8))]
    texts += [base, base, words(20_000), ["x"], ["x"], ["X", "y"], [], [], ["é", "𝄞", "ß"], ["É", "𝄞", "ß"]]
    rows = [(int(k) * 3, " \t\n".join(t)) for k, t in zip(draw.permutation(len(texts)), texts)]
    return rows + [(None, rows[0][1]), (None, "alone here now"), (None, None), (7, None), (7, " \x0b "), rows[5], rows[5], (1, rows[7][1] + "  "), (2, "Y" * 200_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, "d", 3, 4) for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("way", ["plain", "blocks", "shuffled"])
def test_components(spark, rows, way, monkeypatch):
    if way == "blocks":  # clusters of many blocks, dense runs, tiny ranges
        for name, value in {"WORK": 40_000, "SPARSE": 3, "DENSE": 20, "ROWS": 300}.items():
            monkeypatch.setattr(forest, name, value)
    if way == "shuffled":
        monkeypatch.setattr(forest, "SMALL_CLUSTERS", -1)
        monkeypatch.setattr(forest, "SMALL_SETS", 0)
        monkeypatch.setattr(forest, "HASHES", 2000)
    found = forest.label(frame(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(((r[0], r[1], r[2], r[0] == r[2] if r[0] is None and r[2] is not None else r[3] and r[0] is not None) for r in found.collect()), key=str) == [
        (d, n, c, bool(k and d is not None)) for d, n, c, k in plain(rows)
    ]


def test_nothing(spark):
    assert forest.label(frame(spark, [(1, "a b c")]).limit(0)).count() == 0
    assert [tuple(r) for r in forest.label(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
    assert [tuple(r) for r in forest.label(frame(spark, [(None, "a b c")])).collect()] == [(None, 1, None, True)]


def test_linked_by_blocks_equals_linked_at_once():
    draw = np.random.default_rng(2)
    core = draw.integers(0, 1 << 40, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([core[draw.permutation(100)[: draw.integers(88, 100)]], draw.integers(0, 1 << 40, draw.integers(0, 9)).astype(np.uint64)])) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    group = forest.linked(sets, 0, 85)
    assert all(group[i] == group[j] for i, j in want) and len(set(group)) > 1
    across = forest.linked(sets, 25, 85)
    assert all(across[i] == across[j] for i, j in want if j < 25 <= i)


def test_pairs_at_the_threshold_share_a_tree():
    draw = np.random.default_rng(9)
    turned, scaled = forest._constants()
    missed = 0
    for _ in range(400):
        common, own = draw.integers(0, 1 << 63, 340).astype(np.uint64), draw.integers(0, 1 << 63, (2, 30)).astype(np.uint64)
        keys, bits = zip(*[forest.signature(forest.minima(np.concatenate([common, o]), turned, scaled)) for o in own])
        missed += not (keys[0][:, 0] == keys[1][:, 0]).any() or ((bits[0] ^ bits[1]) & (2**64 - 1)).bit_count() > forest.FLIPS
    assert missed == 0
