"""The keyed permutation: one to one for any range, dependent on the key, without a loop in the plan."""

import numpy as np
import pytest

from maskflow.functions.permute import _turned, network, permute
from maskflow.functions.stage import Stage


def images(key, n):
    net = network(key, "s", n)
    y = _turned(np.arange(n, dtype=np.int64), net)
    for _ in range(net.again):
        y = np.where(y >= n, _turned(y, net), y)
    return y


@pytest.mark.parametrize("n", [*range(1, 40), 97, 1000, 9_973, 100_003])
def test_one_to_one(n):
    for key in "abc":
        assert (np.sort(images(key, n)) == np.arange(n)).all()


def test_all_orders_of_few_occur():
    seen = {tuple(images(f"k{k}", 4)) for k in range(3000)}
    assert len(seen) >= 12
    firsts = np.bincount([images(f"k{k}", 7)[0] for k in range(2100)], minlength=7)
    assert firsts.min() > 220 and firsts.max() < 380


def test_neighbours_do_not_stay_together():
    y = images("key", 100_003)
    steps = np.abs(np.diff(y))
    assert 0.3 < steps.mean() / 100_003 < 0.37 and len(np.unique(steps)) > 30_000
    assert abs(np.corrcoef(np.arange(100_003), y)[0, 1]) < 0.02


@pytest.mark.parametrize("n", [10, 9_973, 10**12 + 39, 4 * 10**18])
def test_the_expression_is_the_same(spark, n):
    values = sorted({0, 1, n // 3, n // 2, n - 2, n - 1})
    stage = Stage(spark.createDataFrame([(v,) for v in values], "v bigint"))
    placed = permute(stage, stage.df.v, n, "key", "s")
    got = [r[1] for r in stage.df.select("v", placed.alias("p")).orderBy("v").collect()]
    net = network("key", "s", n)
    want = []
    for v in values:
        y = _turned(np.array([v]), net)
        for _ in range(net.again):
            y = np.where(y >= n, _turned(y, net), y)
        want.append(int(y[0]))
    assert got == want and len(set(got)) == len(got) and all(0 <= v < n for v in got)


def test_ranges_beyond_a_long_are_refused():
    with pytest.raises(ValueError):
        network("key", "s", 2**63)
