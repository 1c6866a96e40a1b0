"""Running folds and places of matches inside a row, against plain Python."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from maskflow.functions.running import CHUNK, placed, running
from maskflow.operators.redact import entity_spans


def test_running_folds(spark):
    sizes = [0, 1, 2, CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK + 7]
    rows = [(n, [(k * 7919) % 101 for k in range(n)]) for n in sizes]
    table = spark.createDataFrame([*rows, (-1, None)], "n int, v array<int>")
    sums = running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("sums")
    tops = running(F.col("v"), F.greatest, F.lit(-1)).alias("tops")
    got = {r.n: (r.sums, r.tops) for r in table.select("n", sums, tops).collect()}
    for n, values in rows:
        assert got[n] == ([sum(values[:k]) for k in range(n)], [max(values[:k], default=-1) for k in range(n)])
    assert got[-1] == (None, None)


def test_places_of_matches(spark):
    texts = ["", "no hit", "a1é𝄞22 333", "4444", "1\n2", "x" * 3000 + "".join(f"é{k} " for k in range(900)), None]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    rows = table.select("id", placed(F.col("text"), "([0-9])[0-9]*", 1).alias("p")).collect()
    for r in rows:
        if texts[r.id] is None:
            assert r.p is None
            continue
        hits = [(m.start(), m[0], m[1]) for m in re.finditer("([0-9])[0-9]*", texts[r.id])]
        assert [(p.at + len(p.before), p.whole, p.counted) for p in r.p if p.whole is not None] == hits
        assert r.p[-1].whole is None and r.p[-1].at + len(r.p[-1].before) == len(texts[r.id])


def test_many_entities_of_one_text(spark):
    def seconds(n):
        letters = spark.createDataFrame([(1, "Anna Meier, " * n)], "id int, text string")
        begun = time.time()
        found = entity_spans(letters, "id", "text").agg(F.count("*").alias("n"), F.sum("start").alias("s")).first()
        assert (found.n, found.s) == (n, 12 * n * (n - 1) // 2)
        return time.time() - begun

    seconds(1000)
    assert seconds(80_000) < 3 * seconds(40_000) + 2
