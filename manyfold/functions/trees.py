"""Arithmetic of regression trees over arrays: bins, growth, prediction, and the bytes of a forest.

Everything here works on many groups and trees at once; Spark decides which rows meet in a task. Sums
are whole numbers, so a tree does not depend on the order in which its rows arrive: a target is told by its
place between the least and the largest one of its group, as a whole number of 52 bits, and is summed in two
halves, so that no sum of fewer than 2**36 rows runs over. A split is chosen by comparing scores computed
from exact sums.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np

PRIME = (1 << 31) - 1
MAGIC = b"MFT2"
NO_LIMIT = 1 << 30
#: Places of the target between the least and the largest, and the bits of the lower half of a place.
GRID = float(1 << 52)
HALF = 26
#: A unit of at most this weight has sums of whole targets below 2**63.
SINGLE = 2047
ENDLESS = "the span of the target is not finite"

# How often a row enters a tree: Poisson(1), as whole-number cuts of the range 0..PRIME.
# The last cut is the largest number below PRIME: the tail is kept to the resolution of the hash.
POISSON_CUTS = [
    math.floor(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(13)
]


@lru_cache(maxsize=1000)
def tree_numbers(seed: int, tree: int) -> tuple[int, int]:
    """Multiplier and offset of the linear hash that draws the row weights of one tree."""
    digest = hashlib.md5(f"{seed}|tree|{tree}".encode()).hexdigest()
    return 1 + int(digest[:8], 16) % (PRIME - 1), int(digest[8:16], 16) % PRIME


def row_weights(order_hash: np.ndarray, seed: int, first: int, last: int) -> np.ndarray:
    """Weights of every row in the trees ``first`` up to ``last``."""
    a, b = np.array([tree_numbers(seed, tree) for tree in range(first, last)], np.int64).reshape(-1, 2, 1).transpose(1, 0, 2)
    drawn = a * (order_hash % PRIME) + b
    # The remainder by 2**31 - 1: what is above 31 bits counts once more.
    for _ in range(2):
        drawn = (drawn & PRIME) + (drawn >> 31)
    drawn = np.where(drawn == PRIME, 0, drawn).astype(np.int32)
    weights = np.zeros(drawn.shape, np.int8)
    for cut in POISSON_CUTS:
        weights += drawn >= cut
    return weights


def without_empty_trees(weights: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The weights, with those of a tree that drew no row of a group set to one in that group."""
    drawn = np.zeros((len(weights), groups), bool)
    tree, row = np.nonzero(weights)
    drawn[tree, group[row]] = True
    weights[~drawn[:, group]] = 1
    return weights


def on_grid(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        span = np.where(high > low, high - low, 1.0)
    if not np.isfinite(span).all():
        raise OverflowError(ENDLESS)
    return np.floor((y - low) / span * GRID + 0.5).astype(np.int64)


def halves(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return q >> HALF, q & ((1 << HALF) - 1)


def wide(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The number that two sums of halves stand for."""
    carry = low >> HALF
    return (high + carry).astype(float) * float(1 << HALF) + (low - (carry << HALF)).astype(float)


def off_grid(high: np.ndarray, low: np.ndarray, weight: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The mean of targets whose halves and weights have these sums."""
    return wide(high, low) / weight.astype(float) / GRID * (most - least) + least


def _first_of_runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def bin_rows(group: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row's value among the distinct values of its group, and its value."""
    by = np.lexsort((x, group))
    g, v = group[by], x[by]
    starts = _first_of_runs(g)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(by))))
    rank = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (v[1:] != v[:-1]))) - 1
    bins = np.empty(len(by), np.int32)
    bins[by] = rank - rank[starts][run]
    return bins, x


def midpoint(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    middle = below + (above - below) / 2
    return np.where(middle >= above, below, middle)


def tree_pairs(weights, group, bins, groups):
    """The (tree, row) pairs with a weight, their unit ``tree * groups + group``, and their order per feature.

    ``weights`` has a row per tree. The orders are by unit and bin; they come from one sort of the rows.
    """
    present = weights > 0
    place = (np.cumsum(present.ravel()) - 1).reshape(present.shape)
    tree, row = np.nonzero(present)
    orders = []
    for b in bins:
        by = np.lexsort((b, group))
        orders.append(place.take(by, axis=1)[present.take(by, axis=1)])
    return tree * groups + group[row], row, weights[present].astype(np.int64), orders


def _members(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of segments that begin there and have these sizes, one segment after the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _interleaved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack([a, b]).ravel()


def _taken(values, order: np.ndarray) -> np.ndarray:
    """``values`` in every order; an array for all orders, or one of each."""
    values = np.broadcast_to(values, (len(order), np.shape(values)[-1]))
    return np.array([v.take(o) for v, o in zip(values, order)])


def grow(unit, row, bins, orders, w, high, low, least, most, count, max_depth, min_split, min_leaf):
    """Grow the trees of all units level by level.

    A pair is a row, or several that share all bins: ``w`` is its weight, ``high`` and ``low`` the halves of its weighted
    target, ``least`` and ``most`` bound its targets, ``count`` says how many rows it stands for. ``bins``
    holds an array per feature, indexed by ``row``; ``max_depth`` and ``min_split`` a limit per unit. The
    order of the pairs by bin is kept per feature and only split in two at every node, so nothing is
    sorted again after the root: first come the left children that go on, then the right ones, and pairs of a node that
    ends leave the orders. In the result children lie side by side. A split is told by the rows on either side of it,
    ``below`` and ``above``.

    Where no unit weighs more than ``SINGLE``, the halves are summed as one number. Running sums go over all nodes
    and may run over 64 bits; their differences, which are sums of single nodes, do not.
    """
    names = ("owner", "feature", "below", "above", "left", "weight", "high", "low", "count", "depth")
    if not len(unit):
        return {k: np.zeros(0, np.int64) for k in names}
    order = np.array(orders)
    start = _first_of_runs(unit[order[0]])
    owner = unit[order[0][start]]
    single = np.add.reduceat(w[order[0]], start).max() <= SINGLE
    targets, firsts = ([(high << HALF) + low], [least]) if single else ([high, low], halves(least))
    counted = not (count == 1).all()
    # The sums of a node: weight, target in one or two parts, and the rows where a pair may stand for several.
    summed = [w, *targets] + ([count] if counted else [])
    bin_of = np.array([b[row] for b in bins])
    part = np.zeros(len(unit), np.int8)

    def score(weight, parts):
        s = parts[0].astype(float) if single else wide(*parts)
        s *= s
        s /= weight
        return s

    def open_nodes(owner, total, rows, sizes, pairs, begin):
        """Which nodes may be split; a node whose targets are all the same is one whose sum says that it could be."""
        splits = (depth < max_depth[owner]) & (rows >= min_split[owner]) & (rows >= 2 * min_leaf) & (sizes > 1)
        head = pairs[begin]
        same = splits.copy()
        for t, value in zip(total[1:], firsts):
            same &= t == total[0] * value[head]
        same = np.flatnonzero(same)
        if len(same):
            at = pairs[_members(begin[same], sizes[same])]
            first = np.cumsum(sizes[same]) - sizes[same]
            splits[same] = np.minimum.reduceat(least[at], first) < np.maximum.reduceat(most[at], first)
        return splits

    levels, base, depth = [], 0, 0
    sizes = np.diff(np.append(start, order.shape[1]))
    total = [np.add.reduceat(a[order[0]], start) for a in summed]
    rows = total[-1] if counted else sizes
    splits = open_nodes(owner, total, rows, sizes, order[0], start)
    order = order[:, np.repeat(splits, sizes)]
    live = np.flatnonzero(splits)
    while True:
        m = len(owner)
        feature, left = np.full(m, -1, np.int32), np.full(m, -1, np.int64)
        below, above = np.full(m, -1, np.int64), np.full(m, -1, np.int64)
        sums = [total[1] >> HALF, total[1] & ((1 << HALF) - 1)] if single else total[1:3]
        levels.append((owner, feature, below, above, left, total[0], *sums, rows, np.full(m, depth, np.int32)))
        if not len(live):
            break
        n, k = order.shape[1], len(live)
        sizes, owner, rows, total = sizes[live], owner[live], rows[live], [t[live] for t in total]
        begin = np.cumsum(sizes) - sizes
        seg, here = np.repeat(np.arange(k), sizes), np.arange(n)

        # A place may part its node where a feature's value changes and enough rows lie on both sides.
        b = _taken(bin_of, order)
        edge = np.zeros(order.shape, bool)
        np.not_equal(b[:, 1:], b[:, :-1], out=edge[:, :-1])
        edge[:, begin + sizes - 1] = False
        # The sums left of a place, it included, and right of it; a node has the same pairs in every order.
        lefts, rights = [], []
        for a, t in zip(summed, total):
            run, upto = np.cumsum(_taken(a, order), axis=1), np.cumsum(t)
            rights.append(upto[seg] - run)
            lefts.append(np.subtract(run, (upto - t)[seg], out=run))
        if counted:
            edge &= (lefts[-1] >= min_leaf) & (rights[-1] >= min_leaf)
        elif min_leaf > 1:
            on_left = here - (begin - 1)[seg]
            edge &= (on_left >= min_leaf) & (sizes[seg] - on_left >= min_leaf)
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = score(lefts[0], lefts[1 : 1 + len(targets)])
            gain += score(rights[0], rights[1 : 1 + len(targets)])
        np.copyto(gain, -np.inf, where=~edge)
        top = np.maximum.reduceat(gain, begin, axis=1)
        best_f = top.argmax(axis=0)
        best = top[best_f, np.arange(k)]
        at = here + np.repeat(best_f * n, sizes)
        pairs = order.ravel().take(at)
        hits = np.flatnonzero(gain.ravel().take(at) == np.repeat(best, sizes))
        best_at = hits[_first_of_runs(seg[hits])]

        # The nodes that are split, in their order within the level.
        slot = np.full(m, -1)
        slot[live[best > -np.inf]] = np.flatnonzero(best > -np.inf)
        split = np.flatnonzero(slot >= 0)
        found = slot[split]
        f, cut = best_f[found], best_at[found]
        feature[split] = f
        left[split] = base + m + 2 * np.arange(len(found))
        below[split], above[split] = row[order[f, cut]], row[order[f, cut + 1]]
        base += m
        depth += 1
        owner = np.repeat(owner[found], 2)
        total = [_interleaved(a[f, cut], t[found] - a[f, cut]) for a, t in zip(lefts, total)]
        left_sizes = cut + 1 - begin[found]
        child_sizes = _interleaved(left_sizes, sizes[found] - left_sizes)
        rows = total[-1] if counted else child_sizes
        splits = open_nodes(owner, total, rows, child_sizes, pairs, _interleaved(begin[found], cut + 1))

        number = np.zeros(k, np.int64)
        number[found] = 2 * np.arange(len(found))
        to_left, to_right = np.zeros(k, np.int8), np.zeros(k, np.int8)
        to_left[found], to_right[found] = splits[::2], 2 * splits[1::2].astype(np.int8)
        part[pairs] = np.where(here <= np.repeat(best_at, sizes), np.repeat(to_left, sizes), np.repeat(to_right, sizes))
        live = np.concatenate([number[to_left > 0], number[to_right > 0] + 1])
        side = part.take(order)
        order = np.concatenate([order[side == s].reshape(len(order), -1) for s in (1, 2)], axis=1)
        sizes = child_sizes
    return {k: np.concatenate(parts) for k, parts in zip(names, zip(*levels))}


def walk(feature, threshold, left, node, row, columns, may_split=None):
    """The node where each row ends. ``may_split`` can stop a walk early, for trials with tighter limits."""
    node = node.copy()
    active = np.arange(len(node))
    while len(active):
        at = node[active]
        onward = feature[at] >= 0
        if may_split is not None:
            onward &= may_split(at, active)
        active, at = active[onward], at[onward]
        node[active] = left[at] + (columns[feature[at], row[active]] > threshold[at])
    return node


def pack(feature, number, left, roots) -> bytes:
    """One forest as bytes: plain arrays, nothing that could be executed on reading.

    A cell of a table has fewer than 2**31 bytes, so 32 bits number every node that fits one.
    """
    return pack_parts([feature], [number], [left], roots)


def pack_parts(feature: list, number: list, left: list, roots) -> bytes:
    """The same of arrays that lie in parts, such as one per tree; they are copied once."""
    sizes = np.array([len(roots), sum(map(len, feature))], "<i4")
    parts = [(roots, "<i4"), *((a, "<i4") for a in left), *((a, "<f8") for a in number), *((a, "<i4") for a in feature)]
    return b"".join([MAGIC, sizes, *(np.ascontiguousarray(a, kind) for a, kind in parts)])


def join(forests: list) -> bytearray:
    """The bytes of one forest that has the trees of several, one after the other; each is copied once, to its place."""
    parts = [unpack(data) for data in forests]
    trees, nodes = (sum(len(p[k]) for p in parts) for k in (3, 0))
    if 12 + 4 * trees + 16 * nodes >= 1 << 31:
        raise ValueError(f"a forest of {nodes} nodes does not fit a cell; score it, or bundle it, as it came from its training")
    body = bytearray(12 + 4 * trees + 16 * nodes)
    body[:12] = MAGIC + np.array([trees, nodes], "<i4").tobytes()
    _, _, _, roots = whole = unpack(body)
    base = first = 0
    for part in parts:
        here = slice(base, base + len(part[0]))
        for to, own in zip(whole[:2], part):
            to[here] = own
        np.add(part[2], base, out=whole[2][here], where=part[2] >= 0)
        whole[2][here][part[2] < 0] = -1
        roots[first : first + len(part[3])] = part[3] + base
        base, first = here.stop, first + len(part[3])
    return body


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``feature, number, left, roots``; ``number`` is a threshold, or at a leaf its value."""
    if data[:4] != MAGIC:
        raise ValueError("these bytes are not a forest")
    trees, nodes = np.frombuffer(data, "<i4", 2, 4)
    at = 12
    roots = np.frombuffer(data, "<i4", trees, at)
    at += 4 * trees
    left = np.frombuffer(data, "<i4", nodes, at)
    at += 4 * nodes
    number = np.frombuffer(data, "<f8", nodes, at)
    feature = np.frombuffer(data, "<i4", nodes, at + 8 * nodes)
    return feature, number, left, roots
