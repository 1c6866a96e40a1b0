"""The source divergence audit against a plain version in Python integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskflow.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, term string, n int, docs int, p string"


def plain(rows, least=3, top=200):
    docs = [(lang or "", source or "", [t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    held, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, terms in docs:
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    for lang in held:
        kept = [t for t, d in held[lang].items() if d >= least]
        sources = [s for g, s in counts if g == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(of, t, kept=kept):
            return 1 + 10**9 * (of[t] + 1) // (sum(of[k] for k in kept) + len(kept))

        p = {s: {t: share(counts[lang, s], t) for t in kept} for s in sources}
        q = {t: share(whole, t) for t in kept}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def odd():
    draw = np.random.default_rng(3)
    rows = [(None, None, None), ("en", None, ""), ("en", "", "Alpha alpha"), ("xx", "only", "one two"), ("yy", "a", "rare"), ("yy", "b", "")]
    for k in range(240):
        lang, source = ("en", "de", None)[k % 3], (f"s{k % 7}", None, "HOT", "HOT")[k % 4]
        words = [f"w{'abcdefghij'[i]}" for i in draw.integers(0, 10, draw.integers(0, 30))] + [f"Ärger{'xyz'[k % 3]}", "ΩMEGA", f"u{'qrst'[k % 4] * (k % 5 + 1)}"]
        rows.append((lang, source, " 12-_[]{}\t".join(words)))
    rows += [("en", "long", "Word, " * 60_000), ("en", "long", "z" * 300_000), *rows[10:14], ("de", "s1", "\x00a\x7fB@`c{é")]
    return [(k, *r, "t", 1, 2, "p") for k, r in enumerate(rows)]


@pytest.mark.parametrize("way", ["plain", "small pieces", "salted"])
def test_audit(spark, odd, way, monkeypatch):
    if way == "small pieces":
        monkeypatch.setattr(divergence, "PIECE_BYTES", 100)
        monkeypatch.setattr(divergence.pieces, "__defaults__", (100,))
        monkeypatch.setattr(divergence, "HELD_ROWS", 60)
    if way == "salted":
        monkeypatch.setattr(divergence, "SMALL_GROUPS", 0)
    found = divergence.audit(spark.createDataFrame(odd, SCHEMA).repartition(3), top=7)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain([r[1:4] for r in odd], top=7)


def test_audit_of_nothing(spark, odd):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    # No kept terms: pairs of value 0 and no terms.
    few = spark.createDataFrame(odd[3:6], SCHEMA)
    assert sorted(map(tuple, divergence.audit(few).collect())) == [("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_for_very_large_counts(spark):
    rows = [(c, t) for t in (7, 10**12 + 39, 8 * 10**15) for c in (0, 5, t // 3, t - 1) if c < t]
    got = spark.createDataFrame(rows, "c long, t long").select(divergence.share(divergence.F.col("c"), divergence.F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // t for c, t in rows]


def test_pairs_of_terms_in_many_sources():
    draw = np.random.default_rng(1)
    term, group = np.repeat(np.arange(40), 9), np.tile(np.arange(9), 40)
    p, none = draw.integers(1, 10**9, 360), draw.integers(1, 1000, 9)[group]

    def f(a, b):
        return (int(a) - int(b)) ** 2 // int(b)

    want = Counter()
    for i in range(360):
        for j in range(360):
            if term[i] == term[j] and i != j:
                want[int(group[i]), int(group[j])] += f(p[i], p[j]) - f(p[i], none[j]) - f(none[i], p[j]) + f(none[i], none[j])
    assert divergence.pair_sums(term, group, p, none) == want
