"""The tree arithmetic against a plain recursive tree, written for clarity and used for nothing else."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from manyfold.functions import trees


def plain_tree(x, q, w, depth, max_depth, min_split, min_leaf):
    """Nested tuples (feature, threshold, left, right), or the weighted mean at a leaf."""
    mean = float(sum(int(a) * int(b) for a, b in zip(w, q))) / int(w.sum())
    n = len(q)
    if q.min() == q.max() or depth >= max_depth or n < min_split or n < 2 * min_leaf:
        return mean
    best = None
    for f in range(x.shape[0]):
        for low, high in zip(np.unique(x[f])[:-1], np.unique(x[f])[1:]):
            left = x[f] <= low
            if left.sum() < min_leaf or (~left).sum() < min_leaf:
                continue
            sums = [float(sum(int(a) * int(b) for a, b in zip(w[side], q[side]))) for side in (left, ~left)]
            gain = sums[0] * sums[0] / int(w[left].sum()) + sums[1] * sums[1] / int(w[~left].sum())
            if best is None or gain > best[0]:
                best = (gain, f, low + (high - low) / 2, left)
    if best is None:
        return mean
    _, f, threshold, left = best
    parts = [plain_tree(x[:, s], q[s], w[s], depth + 1, max_depth, min_split, min_leaf) for s in (left, ~left)]
    return (f, threshold, *parts)


def told(nodes, threshold, at):
    f = nodes["feature"][at]
    if f < 0:
        return float(trees.wide(nodes["high"][at], nodes["low"][at])) / int(nodes["weight"][at])
    left = nodes["left"][at]
    return (int(f), float(threshold[at]), told(nodes, threshold, left), told(nodes, threshold, left + 1))


@settings(max_examples=60, deadline=None)
@given(
    st.integers(0, 10_000),
    st.integers(1, 3),
    st.integers(2, 40),
    st.sampled_from([1, 2, 4]),
    st.sampled_from([2, 5, 10]),
    st.sampled_from([2, 5, trees.NO_LIMIT]),
)
def test_growth(seed, features, n, min_leaf, min_split, max_depth):
    rng = np.random.default_rng(seed)
    groups = 3
    group = rng.integers(0, groups, n * groups)
    x = rng.integers(0, rng.integers(2, 12), (features, len(group))).astype(float)
    q = rng.integers(0, rng.choice([1000, 1 << 52]), len(group))
    weights = rng.integers(0, 3, (2, len(group))).astype(np.int8)
    bins, values = zip(*[trees.bin_rows(group, column) for column in x])
    unit, row, w, orders = trees.tree_pairs(weights, group, bins, groups)
    if not len(unit):
        return
    units = 2 * groups
    limits = np.full(units, max_depth), np.full(units, min_split)
    high, low = trees.halves(q[row])
    nodes = trees.grow(unit, row, bins, orders, w, w * high, w * low, q[row], q[row], np.ones_like(w), *limits, min_leaf)
    inner = nodes["feature"] >= 0
    threshold = np.zeros(len(inner))
    f = nodes["feature"][inner]
    values = np.array(values)
    threshold[inner] = trees.midpoint(values[f, nodes["below"][inner]], values[f, nodes["above"][inner]])
    for at in np.flatnonzero(nodes["depth"] == 0):
        tree, g = divmod(int(nodes["owner"][at]), groups)
        mine = (group == g) & (weights[tree] > 0)
        want = plain_tree(x[:, mine], q[mine], weights[tree][mine].astype(int), 0, max_depth, min_split, min_leaf)
        assert told(nodes, threshold, at) == want


def test_every_value_has_its_rank():
    rng = np.random.default_rng(1)
    group = np.repeat([0, 1], [1000, 5])
    x = rng.normal(size=1005)
    bins, values = trees.bin_rows(group, x)
    assert sorted(bins[:1000]) == list(range(1000)) and sorted(bins[1000:]) == [0, 1, 2, 3, 4]
    assert np.array_equal(values, x) and np.array_equal(np.argsort(bins[:1000]), np.argsort(x[:1000]))


def test_sums_of_halves_are_whole():
    rng = np.random.default_rng(2)
    q = rng.integers(0, (1 << 52) + 1, 5000)
    high, low = trees.halves(q)
    exact = sum(map(int, q))
    assert trees.wide(np.array(high.sum()), np.array(low.sum())) == float(exact)
    y = rng.normal(size=1000) * 1e6
    back = trees.off_grid(*trees.halves(trees.on_grid(y, y.min(), y.max())), np.ones(1000, np.int64), y.min(), y.max())
    assert np.abs(back - y).max() <= 4e-16 * (y.max() - y.min()) + 1e-9


def test_weights_are_poisson():
    rng = np.random.default_rng(0)
    weights = trees.row_weights(rng.integers(0, 1 << 60, 20_000), 42, 0, 20)
    assert weights.mean() == pytest.approx(1.0, abs=0.02)
    assert weights.var() == pytest.approx(1.0, abs=0.03)
    assert (weights == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_bytes_round_trip():
    feature, number = np.array([1, -1, -1], np.int16), np.array([0.5, 1.25, -3.0])
    left, roots = np.array([1, -1, -1]), np.array([0])
    back = trees.unpack(trees.pack(feature, number, left, roots))
    for got, want in zip(back, (feature, number, left, roots)):
        assert np.array_equal(got, want)
    with pytest.raises(ValueError):
        trees.unpack(b"\x80\x04}")


def test_midpoint_never_reaches_the_upper_value():
    a = np.array([1.0, 1.0])
    b = np.array([np.nextafter(1.0, 2.0), 2.0])
    middle = trees.midpoint(a, b)
    assert np.all((a <= middle) & (middle < b))
