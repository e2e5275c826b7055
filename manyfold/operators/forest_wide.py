"""Forests of groups that are too large for one task, with every split tried.

Every feature of such a group has an attribute list: its rows in order of the feature's value, dealt to sorted ranges once
and kept in chunks. Nodes with many rows are split on these lists, level by level and without moving them: a chunk gives
sums per tree and node, a window over the chunks turns them into the sums before each chunk, and with these a chunk finds
the best of its own cuts. What a tree draws follows from a hash, so no row is ever repeated per tree.

A node with few enough rows is finished by one task. Rows travel there in blocks, an array per column, those held out with
them; the task grows the rest of the tree and answers with its nodes and with the votes on the held-out rows. A tree is
grown once per key and ``min_samples_leaf``, to the loosest limits of all trials, and every trial reads it under its own.
Only what is needed travels: a node is told by its feature and one number, since nodes lie level by level; what a tighter
trial would make of it is kept only where there are several. The nodes of some trees of a key meet once, in the task
that packs them as a piece of its model, so no task has a whole model.

``rows_per_task`` says which groups are worked on so. A node is left to a task from that many rows down, or from half the
rows of its group, if that is more and still fits a task. Targets that hang little on the features make lopsided trees, which
lose few rows per level, and every level is two passes: this way a larger group has hardly more levels, and hardly more
nodes that rows are sent to. Any such size gives the same trees. A pass looks only at trees that have a node to split.

The driver keeps the upper nodes, at most two per so many rows of a tree, for as many trees at a time as
``TREES_AT_ONCE`` says; no model and no row. A group that fails in a task gets a status and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from manyfold.functions import trees
from manyfold.operators.linear import data_faults, fault_status
from manyfold.operators.skew import task_count
from manyfold.operators.split import HELD, ORDER, SplitRows
from manyfold.schema import ERROR, HYPERPARAMETERS, SUCCESS
from manyfold.sources.pieces import PIECE
from manyfold.sources.settled import settle

#: Entries of a chunk of an attribute list, rows of a block, and held-out rows that are put together at once.
CHUNK, BLOCK, SCORED = 1 << 16, 1 << 14, 2_000
#: Pairs of a row and a tree that a task looks at together.
PAIRS_AT_ONCE = 1_000_000
#: Rows of the trees of a piece of a model; a tree that has more is a piece of its own.
PIECE_ROWS = 100_000
#: Trees whose upper nodes the driver keeps at a time; keys beyond are a round of their own.
TREES_AT_ONCE = 200_000
#: A node with at most one in so many rows of its group is left to a task, up to the rows that fit one.
SHARES, LOCAL_ROWS = 2, 1_000_000

OPEN, INNER, LEAF, LOCAL = range(4)


@dataclass
class Tops:
    """The upper nodes of all trees of a round, in flat arrays; the first nodes are the roots, one per unit."""

    key: np.ndarray  # of every unit: its key, min_samples_leaf, tree and the loosest limits of its trials
    leaf: np.ndarray
    tree: np.ndarray
    deepest: np.ndarray
    smallest: np.ndarray
    whole: np.ndarray  # units that drew no row and take all of them once
    span: dict[int, tuple[float, float]]  # least and largest target of a key
    limits: dict[tuple[int, int], list[tuple[int, int]]]  # different (depth, split) limits of a key and leaf size
    buckets: dict[int, int]
    seed: int
    local: np.ndarray  # of every unit: how many rows a node may have that is left to a task
    piece: np.ndarray  # of every unit: the first tree of the piece of its key's model
    nodes: dict[str, np.ndarray] = field(default_factory=dict)

    KINDS = {"unit": np.int64, "up": np.int64, "depth": np.int32, "feature": np.int32, "threshold": float, "left": np.int64, "weight": np.int64, "high": np.int64, "low": np.int64, "count": np.int64, "state": np.int8}

    def __post_init__(self):
        n = len(self.key)
        blank = {"unit": np.arange(n), "up": -1, "depth": 0, "feature": -1, "threshold": 0.0, "left": -1, "state": OPEN}
        self.nodes = {k: np.full(n, blank.get(k, 0), kind) if k != "unit" else np.arange(n) for k, kind in self.KINDS.items()}

    def units_of(self, key: int) -> np.ndarray:
        return np.flatnonzero(self.key == key)

    def units_with(self, key: int, state: int) -> np.ndarray:
        """The trees of a key that have a node in a state."""
        some = np.zeros(len(self.key), bool)
        some[self.nodes["unit"][self.nodes["state"] == state]] = True
        return np.flatnonzero(some & (self.key == key))

    def add(self, **columns) -> np.ndarray:
        first = len(self.nodes["unit"])
        for name, kind in self.KINDS.items():
            self.nodes[name] = np.concatenate([self.nodes[name], np.asarray(columns[name], kind)])
        return np.arange(first, len(self.nodes["unit"]))

    def value(self, node: int) -> float:
        n = self.nodes
        low, high = self.span[int(self.key[n["unit"][node]])]
        return float(trees.off_grid(n["high"][node], n["low"][node], n["weight"][node], low, high))

    def path(self, node: int) -> list[int]:
        found = [node]
        while self.nodes["up"][found[-1]] >= 0:
            found.append(int(self.nodes["up"][found[-1]]))
        return found[::-1]

    def votes(self, node: int) -> list[float | None]:
        """What a row that comes to a node gets under each pair of limits; None where it goes on below."""
        unit = int(self.nodes["unit"][node])
        path, out = self.path(node), []
        for depth, split in self.limits[int(self.key[unit]), int(self.leaf[unit])]:
            ends = [k for k in path if self.nodes["depth"][k] >= depth or self.nodes["count"][k] < split]
            if self.nodes["state"][node] == LEAF:
                ends.append(node)
            out.append(self.value(ends[0]) if ends else None)
        return out

    def drawn(self, key: int, order_hash: np.ndarray, x: np.ndarray, state: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, weight and node of all pairs of a row and a tree that drew it whose node is in a state, a few trees at a time."""
        yield from self._pairs(key, x, lambda units: self.weights(units, order_hash), state)

    def all_rows(self, key: int, x: np.ndarray, state: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        yield from self._pairs(key, x, lambda units: np.ones((len(units), x.shape[1]), np.int8), state)

    def weights(self, units: np.ndarray, order_hash: np.ndarray) -> np.ndarray:
        found = np.concatenate([trees.row_weights(order_hash, self.seed, t, t + 1) for t in self.tree[units].tolist()])
        found[self.whole[units]] = 1
        return found

    def _pairs(self, key, x, weigh, state):
        units = self.units_with(key, state)
        step = max(1, PAIRS_AT_ONCE // max(1, x.shape[1]))
        n = self.nodes
        for at in range(0, len(units), step):
            some = units[at : at + step]
            weights = weigh(some)
            unit, row = np.nonzero(weights)
            node = trees.walk(n["feature"], n["threshold"], n["left"], some[unit], row, x)
            at = np.flatnonzero(n["state"][node] == state)
            yield row[at], weights[unit[at], row[at]].astype(np.int64), node[at]


def first_of_runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)


def group_facts(rows: DataFrame, names: list[str], p: int, min_rows: int) -> DataFrame:
    """Per group: its number among the hot ones, why it cannot be fitted, if so, and the span of its target."""
    fit = ~F.col(HELD)
    facts = rows.groupBy(*names).agg(
        *data_faults(p),
        F.count(F.when(F.col(HELD), F.lit(1))).alias("held_rows"),
        F.min(F.when(fit, F.col("y"))).alias("least_y"),
        F.max(F.when(fit, F.col("y"))).alias("most_y"),
    )
    endless = F.when(F.col("most_y") - F.col("least_y") == F.lit(float("inf")), F.lit(ERROR + trees.ENDLESS))
    facts = facts.select(*names, "num_rows", F.coalesce(fault_status(min_rows), endless).alias("fault"), "held_rows", "least_y", "most_y")
    # The list of hot groups is bounded, so one task may number it.
    return settle(settle(facts, "groups").coalesce(1).sortWithinPartitions(*names).withColumn("g", F.monotonically_increasing_id().cast("int")), "facts")


def grid(y, low, high):
    return F.floor((y - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)) * F.lit(trees.GRID) + F.lit(0.5)).cast("long")


def chunk_rows(p: int):
    """Packs a sorted range of attribute lists into chunks, each with the entries of one key and feature."""
    columns = ["v", *[f"x{i}" for i in range(p)], ORDER, "q"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, now, size = [], None, 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.array([table.column(c).to_numpy()]) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([number], pa.int64()), *lists], ["g", "f", "chunk", *columns])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (f[1:] != f[:-1])) + 1).tolist(), len(g)]
            for a, b in zip(cuts, cuts[1:]):
                for at in range(a, b, CHUNK):
                    part = batch.slice(at, min(b, at + CHUNK) - at)
                    if held and (now != (g[at], f[at]) or size + part.num_rows > CHUNK):
                        yield out()
                        held, size, number = [], 0, number + 1
                    held.append(part)
                    now, size = (g[at], f[at]), size + part.num_rows
        if held:
            yield out()

    return rows


def attribute_lists(fit_rows: DataFrame, p: int) -> DataFrame:
    slots = [f"x{i}" for i in range(p)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(x).alias("v")) for i, x in enumerate(slots)])).alias("e")
    entries = fit_rows.select("g", "id", *slots, ORDER, "q", each).select("g", "e.f", "e.v", *slots, ORDER, "q", "id")
    order = ["g", "f", "v", "id"]
    schema = "g int, f int, chunk long, v array<double>, " + "".join(f"{x} array<double>, " for x in slots) + f"{ORDER} array<long>, q array<long>"
    lists = entries.repartitionByRange(*order).sortWithinPartitions(*order).drop("id").mapInArrow(chunk_rows(p), schema)
    return settle(lists, "lists")


def lists_of(batch: pa.RecordBatch, p: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks one by one: key, feature, chunk, values, all features, order hashes and gridded targets."""
    for k in range(batch.num_rows):
        values = [batch.column(c)[k].values.to_numpy() for c in ["v", *[f"x{i}" for i in range(p)], ORDER, "q"]]
        g, f, chunk = (batch.column(c)[k].as_py() for c in ("g", "f", "chunk"))
        yield g, f, chunk, values[0], np.array(values[1:-2]), values[-2], values[-1]


PARTIAL = "chunk long, f int, node long, first double, c long, w long, s_high long, s_low long, least long, most long"


def partial_sums(p: int, tops):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PARTIAL.split(", ")]
        known = tops.value
        for batch in batches:
            for g, f, chunk, v, x, order_hash, q in lists_of(batch, p):
                for row, w, node in known.drawn(g, order_hash, x, OPEN):
                    if not len(row):
                        continue
                    by = np.argsort(node, kind="stable")
                    row, w, node = row[by], w[by], node[by]
                    at = first_of_runs(node)
                    high, low = trees.halves(q[row])
                    sums = [np.add.reduceat(a, at) for a in (np.ones_like(w), w, w * high, w * low)]
                    ends = [np.minimum.reduceat(q[row], at), np.maximum.reduceat(q[row], at)]
                    same = np.ones(len(at), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (same * chunk, (same * f).astype(np.int32), node[at], v[row[at]], *sums, *ends)], names)

    return rows


CUT = "node long, f int, gain double, below double, above double, c long, w long, s_high long, s_low long"


def best_cuts(p: int, tops):
    """The best cut of every node among those whose lower side ends in the chunk."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CUT.split(", ")]
        known = tops.value
        for batch in batches:
            for k, (g, f, _, v, x, order_hash, q) in enumerate(lists_of(batch, p)):
                told = batch.column("before")[k].values
                before = {c: told.field(c).to_numpy(zero_copy_only=False) for c in ("node", "c0", "w0", "high0", "low0", "c_all", "w_all", "high_all", "low_all", "next")}
                sort = np.argsort(before["node"])
                before = {c: a[sort] for c, a in before.items()}
                for row, w, node in known.drawn(g, order_hash, x, OPEN):
                    if not len(row):
                        continue
                    by = np.argsort(node, kind="stable")
                    row, w, node = row[by], w[by], node[by]
                    start = first_of_runs(node)
                    size = np.diff(np.append(start, len(node)))
                    own = np.searchsorted(before["node"], node[start])
                    seg = np.repeat(np.arange(len(start)), size)
                    high, low = trees.halves(q[row])

                    def upto(a: np.ndarray, name: str) -> np.ndarray:
                        total = np.cumsum(a)
                        return total - (total[start] - a[start])[seg] + before[name][own][seg]

                    c, w_left, h_left, l_left = upto(np.ones_like(w), "c0"), upto(w, "w0"), upto(w * high, "high0"), upto(w * low, "low0")
                    here = v[row]
                    above = np.append(here[1:], np.nan)
                    last = start + size - 1
                    above[last] = before["next"][own]
                    every = {c_: before[c_][own][seg] for c_ in ("c_all", "w_all", "high_all", "low_all")}
                    least = known.leaf[known.nodes["unit"][node]]
                    at = np.flatnonzero((above != here) & ~np.isnan(above) & (c >= least) & (every["c_all"] - c >= least))
                    if not len(at):
                        continue
                    left = trees.wide(h_left[at], l_left[at])
                    right = trees.wide(every["high_all"][at] - h_left[at], every["low_all"][at] - l_left[at])
                    gain = left * left / w_left[at] + right * right / (every["w_all"][at] - w_left[at])
                    runs = first_of_runs(seg[at])
                    top = np.maximum.reduceat(gain, runs)
                    hits = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(runs, len(at)))))
                    hits = at[hits[first_of_runs(seg[at][hits])]]
                    columns = (node[hits], np.full(len(hits), f, np.int32), top, here[hits], above[hits], c[hits], w_left[hits], h_left[hits], l_left[hits])
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in columns], names)

    return rows


def grow_tops(lists: DataFrame, tops: Tops, p: int) -> None:
    """Splits nodes on the attribute lists until none has more rows than a task takes; the rest is left to tasks."""
    context = lists.sparkSession.sparkContext
    sums = ["c", "w", "s_high", "s_low"]
    over = Window.partitionBy("node", "f")
    ordered = over.orderBy("chunk")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    while (tops.nodes["state"] == OPEN).any():
        told = context.broadcast(tops)
        partial = settle(lists.mapInArrow(partial_sums(p, told), PARTIAL), "partial")
        nodes = partial.filter("f = 0").groupBy("node").agg(*[F.sum(s).alias(s) for s in sums], F.min("least").alias("least"), F.max("most").alias("most"))
        facts = nodes.toPandas().set_index("node")
        n = tops.nodes
        open_ = np.flatnonzero(n["state"] == OPEN)
        if (without := open_[~np.isin(open_, facts.index)]).size:
            tops.whole[n["unit"][without]] = True  # only a root can be without rows: its tree drew none
            continue
        facts = facts.loc[open_]
        for name, column in (("count", "c"), ("weight", "w"), ("high", "s_high"), ("low", "s_low")):
            n[name][open_] = facts[column].to_numpy()
        unit = n["unit"][open_]
        may = (facts["least"] < facts["most"]).to_numpy() & (n["depth"][open_] < tops.deepest[unit])
        may &= (n["count"][open_] >= tops.smallest[unit]) & (n["count"][open_] >= 2 * tops.leaf[unit])
        n["state"][open_[~may]] = LEAF
        # A tree with few rows in all is not taken apart.
        few = may & (n["count"][open_] <= tops.local[unit])
        n["state"][open_[few]] = LOCAL
        if not (n["state"] == OPEN).any():
            return
        told = context.broadcast(tops)
        before = partial.select(
            "chunk", "node",
            *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(a) for s, a in zip(sums, ("c0", "w0", "high0", "low0"))],
            *[F.sum(s).over(over).alias(a) for s, a in zip(sums, ("c_all", "w_all", "high_all", "low_all"))],
            F.lead("first").over(ordered).alias("next"),
        )
        fields = [c for c in before.columns if c != "chunk"]
        by_chunk = before.groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias("before"))
        cuts = lists.join(by_chunk, "chunk").mapInArrow(best_cuts(p, told), CUT)
        rank = F.struct("gain", (-F.col("f")).alias("f"), (-F.col("below")).alias("below"))
        best = cuts.groupBy("node").agg(F.max_by(F.struct(*cuts.columns[1:]), rank).alias("cut")).select("node", "cut.*").toPandas()
        apply_cuts(tops, best)


def apply_cuts(tops: Tops, best) -> None:
    n = tops.nodes
    open_ = np.flatnonzero(n["state"] == OPEN)
    best = best.sort_values("node")
    node = best["node"].to_numpy()
    n["state"][open_] = LEAF
    n["state"][node] = INNER
    n["feature"][node] = best["f"].to_numpy()
    n["threshold"][node] = trees.midpoint(best["below"].to_numpy(), best["above"].to_numpy())
    n["left"][node] = len(n["unit"]) + 2 * np.arange(len(node))

    def pairs(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.column_stack([left, whole - left]).ravel()

    count = pairs(best["c"].to_numpy(), n["count"][node])
    twice = lambda a: np.repeat(a, 2)
    unit, depth = twice(n["unit"][node]), twice(n["depth"][node] + 1)
    may = (depth < tops.deepest[unit]) & (count >= tops.smallest[unit]) & (count >= 2 * tops.leaf[unit])
    tops.add(
        unit=unit, up=twice(node), depth=depth, feature=np.full(len(unit), -1), threshold=np.zeros(len(unit)), left=np.full(len(unit), -1),
        weight=pairs(best["w"].to_numpy(), n["weight"][node]), high=pairs(best["s_high"].to_numpy(), n["high"][node]),
        low=pairs(best["s_low"].to_numpy(), n["low"][node]), count=count,
        state=np.where(may, np.where(count > tops.local[unit], OPEN, LOCAL), LEAF),
    )


ROW_ARRAYS = "w array<byte>, q array<long>, id array<long>, y array<double>"
#: Columns of a block that only rows drawn by the tree have, and those that only held-out rows have.
FIT_ONLY, HELD_ONLY = ["w", "q"], ["id", "y"]


def node_blocks(p: int, tops, per: int):
    """Rows of every node that is left to a task, as arrays: first those a tree drew, then those held out."""
    slots = [f"x{i}" for i in range(p)]
    names = ["g", "node", *slots, *FIT_ONLY, *HELD_ONLY]
    parts_of = {False: [*slots, *FIT_ONLY], True: [*slots, *HELD_ONLY]}
    empty = {"w": np.zeros(0, np.int8), "q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "y": np.zeros(0)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tops.value
        waiting: dict[int, dict[tuple[bool, str], list]] = {}
        sizes: dict[int, int] = {}
        total = 0

        def out(nodes) -> pa.RecordBatch:
            lists = [[] for _ in names[2:]]
            for node in nodes:
                own = waiting.pop(node)
                for name, column in zip(names[2:], lists):
                    parts = [a for held in (False, True) for a in own.get((held, name), [])]
                    column.append(np.concatenate(parts) if parts else empty[name])
                sizes.pop(node)
            key = known.key[known.nodes["unit"][np.array(nodes)]].astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes, pa.int64()), *map(pa.array, lists)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["g", "id", HELD, ORDER, "y", "q", *slots]}
            for g in np.unique(column["g"]).tolist():
                for held in (False, True):
                    own = np.flatnonzero((column["g"] == g) & (column[HELD] == held))
                    if not len(own) or not len(known.units_with(g, LOCAL)):
                        continue
                    x = np.array([column[s][own] for s in slots])
                    for row, w, node in known.all_rows(g, x, LOCAL) if held else known.drawn(g, column[ORDER][own], x, LOCAL):
                        by = np.argsort(node, kind="stable")
                        row, w, node = row[by], w[by], node[by]
                        cuts = np.append(first_of_runs(node), len(node))
                        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                            at, number = own[row[a:b]], int(node[a])
                            for name in parts_of[held]:
                                part = w[a:b].astype(np.int8) if name == "w" else column[name][at]
                                waiting.setdefault(number, {}).setdefault((held, name), []).append(part)
                            sizes[number] = sizes.get(number, 0) + b - a
                            total += b - a
                            if sizes[number] >= BLOCK:
                                total -= sizes[number]
                                yield out([number])
            if total > per:
                yield out(list(waiting))
                total = 0
        if waiting:
            yield out(list(waiting))

    return rows


#: ``number`` is a threshold, or at a leaf its value. Value and count of all nodes are told where trials differ in their limits.
GROWN = "g int, unit long, node long, feature array<short>, number array<double>, value array<double>, count array<long>, bucket int, id array<long>, y array<double>, vote array<double>, problem string"


def grown_rows(p: int, tops):
    """The rest of a tree below one node, and the votes on the held-out rows that come to it."""
    target = to_arrow_schema(GROWN_TYPE)
    blank = {f.name: None for f in target}

    def grow(table: pa.Table) -> pa.Table:
        g, node = table.column("g")[0].as_py(), table.column("node")[0].as_py()
        known = tops.value
        unit = int(known.nodes["unit"][node])
        base = {**blank, "g": g, "unit": unit, "node": node}
        try:
            out = [{**base, **piece} for piece in finished(known, unit, node, table)]
        except Exception as problem:  # a group that fails stands alone
            out = [{**base, "problem": str(problem)}]
        return pa.Table.from_pylist(out, schema=target)

    def finished(known: Tops, unit: int, node: int, table: pa.Table) -> Iterator[dict]:
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        x, own, q, ids, y = np.array([flat(f"x{i}") for i in range(p)]), flat("w").astype(np.int64), flat("q"), flat("id"), flat("y")
        sizes, drawn = (pc.list_value_length(table.column(c)).to_numpy() for c in ("x0", "w"))
        in_block = np.arange(x.shape[1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        is_fit = in_block < np.repeat(drawn, sizes)
        fit, held = np.flatnonzero(is_fit), np.flatnonzero(~is_fit)
        # Rows come in any order, which changes nothing: sums are exact, and a cut lies between two values.
        zero = np.zeros(len(fit), np.int64)
        bins, values = zip(*[trees.bin_rows(zero, column[fit]) for column in x])
        high, low = trees.halves(q)
        depth = int(known.nodes["depth"][node])
        limits = np.array([known.deepest[unit] - depth]), np.array([known.smallest[unit]])
        orders = [np.argsort(b, kind="stable") for b in bins]
        nodes = trees.grow(zero, np.arange(len(fit)), list(bins), orders, own, own * high, own * low, q, q, np.ones_like(own), *limits, int(known.leaf[unit]))
        inner = np.flatnonzero(nodes["feature"] >= 0)
        feature = nodes["feature"][inner]
        threshold = np.zeros(len(nodes["owner"]))
        values = np.array(values)
        threshold[inner] = trees.midpoint(values[feature, nodes["below"][inner]], values[feature, nodes["above"][inner]])
        key = int(known.key[unit])
        value = trees.off_grid(nodes["high"], nodes["low"], nodes["weight"], *known.span[key])
        deep = nodes["depth"] + depth
        limits = known.limits[key, int(known.leaf[unit])]
        piece = {"feature": nodes["feature"].astype(np.int16), "number": np.where(nodes["feature"] >= 0, threshold, value)}
        yield piece if len(limits) == 1 else {**piece, "value": value, "count": nodes["count"]}
        if not len(held):
            return
        votes = np.empty((len(held), 0))
        for (most, split), told in zip(limits, known.votes(node)):
            if told is None:
                may = lambda at, _, most=most, split=split: (deep[at] < most) & (nodes["count"][at] >= split)
                leaf = trees.walk(nodes["feature"], threshold, nodes["left"], np.zeros(len(held), np.int64), held, x, may)
                told = value[leaf]
            votes = np.column_stack([votes, np.broadcast_to(told, len(held))])
        yield from vote_blocks(known, unit, ids, y, votes)

    return grow


def vote_blocks(known: Tops, unit: int, ids: np.ndarray, y: np.ndarray, votes: np.ndarray) -> Iterator[dict]:
    """Votes by bucket of held-out rows; the truth travels with the first tree alone, which votes on every row too."""
    bucket = ids % known.buckets[int(known.key[unit])]
    first = known.tree[unit] == 0
    by = np.argsort(bucket, kind="stable")
    cuts = np.append(first_of_runs(bucket[by]), len(by))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        at = by[a:b]
        yield {"bucket": int(bucket[at[0]]), "id": ids[at], "y": y[at] if first else None, "vote": votes[at].ravel()}


_LIST = {"short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}


def _typed(ddl: str) -> T.StructType:
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(T.StructField(name, T.ArrayType(_LIST[inner]) if inner != kind else _LIST[kind]))
    return T.StructType(fields)


GROWN_TYPE = _typed(GROWN)


def leaf_votes(p: int, tops):
    """Votes on held-out rows whose way ends in a leaf among the upper nodes."""
    slots = [f"x{i}" for i in range(p)]
    target = to_arrow_schema(GROWN_TYPE)
    blank = {f.name: None for f in target}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tops.value
        for batch in batches:
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["g", "id", "y", *slots]}
            for g in np.unique(column["g"]).tolist():
                own = np.flatnonzero(column["g"] == g)
                for row, _, node in known.all_rows(g, np.array([column[s][own] for s in slots]), LEAF):
                    by = np.argsort(node, kind="stable")
                    row, node = row[by], node[by]
                    cuts = np.append(first_of_runs(node), len(node))
                    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                        at, number = own[row[a:b]], int(node[a])
                        base = {**blank, "g": g, "unit": int(known.nodes["unit"][number])}
                        votes = np.tile(known.votes(number), (b - a, 1))
                        out = [{**base, **v} for v in vote_blocks(known, base["unit"], column["id"][at], column["y"][at], votes)]
                        yield from pa.Table.from_pylist(out, schema=target).to_batches()

    return rows


ERRORS = "g int, trial long, squares double, gaps double, n long"


def bucket_errors(trials: dict[int, list[tuple]], tops):
    """Errors of every trial on a bucket of held-out rows: the first trees of the trial, in order, under its limits."""
    names = [c.split()[0] for c in ERRORS.split(", ")]

    def errors(table: pa.Table) -> pa.Table:
        known, g = tops.value, table.column("g")[0].as_py()
        units = table.column("unit").to_numpy()
        ids = np.unique(np.concatenate([c.values.to_numpy() for c in table.column("id")]))
        y = np.empty(len(ids))
        votes = {leaf: np.full((int((known.leaf[known.units_of(g)] == leaf).sum()), len(ids), len(pairs)), np.nan) for (key, leaf), pairs in known.limits.items() if key == g}
        for unit, id_, own, vote in zip(units, *(table.column(c) for c in ("id", "y", "vote"))):
            at = np.searchsorted(ids, id_.values.to_numpy())
            if own.is_valid:
                y[at] = own.values.to_numpy()
            votes[int(known.leaf[unit])][int(known.tree[unit]), at] = vote.values.to_numpy().reshape(len(at), -1)
        out = []
        for trial, leaf, size, depth, split in trials[g]:
            place = known.limits[g, leaf].index((depth, split))
            total = np.zeros(len(ids))
            for tree in range(size):
                total += votes[leaf][tree, :, place]
            gap = y - total / size
            out.append((g, trial, float((gap * gap).sum()), float(np.abs(gap).sum()), len(ids)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))], names)

    return errors


def left_of(feature: np.ndarray) -> np.ndarray:
    """The left child of every node of a tree that lies level by level, children side by side in the order of their parents."""
    inner = feature >= 0
    return np.where(inner, 2 * np.cumsum(inner) - 1, -1)


def depth_of(feature: np.ndarray, top: int) -> np.ndarray:
    """The depth of every node of such a tree whose root has the depth ``top``."""
    depth, begin, end = np.empty(len(feature), np.int32), 0, 1
    while begin < end:
        depth[begin:end] = top
        begin, end, top = end, end + 2 * int((feature[begin:end] >= 0).sum()), top + 1
    return depth


def tree_arrays(known: Tops, unit: int, pieces: list[dict], limits: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, number and left child of one tree level by level, under a trial's limits if others are looser."""
    n = known.nodes
    mine = np.flatnonzero(n["unit"] == unit)
    at = {int(k): i for i, k in enumerate(mine)}
    value = np.array([known.value(int(k)) for k in mine])
    feature, left = n["feature"][mine], np.array([at[int(k)] if k >= 0 else -1 for k in n["left"][mine]])
    columns = {"feature": [feature.copy()], "number": [np.where(feature >= 0, n["threshold"][mine], value)], "left": [left]}
    if limits is not None:
        columns |= {"value": [value], "depth": [n["depth"][mine]], "count": [n["count"][mine]]}
    base = len(mine)
    for piece in pieces:
        # The root of a piece is an upper node already.
        top, size = at[piece["node"]], len(piece["feature"])
        told = {**piece, "left": left_of(piece["feature"])}
        if limits is not None:
            told["depth"] = depth_of(piece["feature"], int(n["depth"][piece["node"]]))
        for k in columns:
            own = told[k]
            own = np.where(own >= 0, own + base, -1) if k == "left" else own
            columns[k][0][top] = own[0]
            columns[k].append(own)
        base += size
    c = {k: np.concatenate(v) for k, v in columns.items()}
    inner = c["feature"] >= 0
    if limits is not None:
        inner &= (c["depth"] < limits[0]) & (c["count"] >= limits[1])
    levels, here = [], np.array([0])
    while len(here):
        levels.append(here)
        goes = here[inner[here]]
        here = np.column_stack([c["left"][goes], c["left"][goes] + 1]).ravel().astype(np.int64)
    order = np.concatenate(levels)
    split_here = inner[order]
    feature = np.where(split_here, c["feature"][order], -1)
    number = c["number"][order]
    if limits is not None:
        number = np.where(split_here, number, c["value"][order])
    return feature, number, left_of(feature)


def packed_forest(tops):
    """Some trees of one key: a row per tree with the limits of its trial, and the parts of the trees below the upper nodes."""

    def forest(table: pa.Table) -> pa.Table:
        known = tops.value
        node, unit = table.column("node").to_pylist(), table.column("unit").to_pylist()
        pieces: dict[int, list[int]] = {u: [] for u, k in zip(unit, node) if k is None}
        wanted = {u: at for at, (u, k) in enumerate(zip(unit, node)) if k is None}
        for at, (u, k) in enumerate(zip(unit, node)):
            if k is not None:
                pieces[u].append(at)
        grown, roots, base = {"left": [], "number": [], "feature": []}, [], 0
        for u in sorted(wanted, key=lambda u: known.tree[u]):
            limits, names = None, ["feature", "number"]
            if len(known.limits[int(known.key[u]), int(known.leaf[u])]) > 1:
                depth, split = (table.column(c)[wanted[u]].as_py() for c in ("max_depth", "min_samples_split"))
                limits, names = (trees.NO_LIMIT if depth is None else depth, split), [*names, "value", "count"]
            own = [{"node": node[at], **{c: table.column(c)[at].values.to_numpy() for c in names}} for at in pieces[u]]
            feature, number, left = tree_arrays(known, u, own, limits)
            roots.append(base)
            for name, a in (("left", np.where(left >= 0, left + base, -1).astype("<i4")), ("number", number.astype("<f8")), ("feature", feature.astype("<i4"))):
                grown[name].append(a)
            base += len(feature)
        body = trees.pack_parts(grown["feature"], grown["number"], grown["left"], roots)
        columns = [table.column(c).slice(0, 1).combine_chunks() for c in ("g", PIECE)]
        return pa.table([*columns, pa.array([body], pa.binary())], ["g", PIECE, "model_bytes"])

    return forest


class WideFit:
    """The forests of the hot groups of a split, grown once for all trials of a plan."""

    def __init__(self, split: SplitRows, p: int, settings, plan: DataFrame | None, min_rows: int, seed: int, limit: int):
        names, rows, hot = split.code.names, split.hot, split.sizes.hot
        self.names, self.code, self.p = names, split.code, p
        self.facts = group_facts(rows, names, p, min_rows)
        if plan is None:
            chosen = {"trial": 0, **asdict(settings)}
            plan = self.facts.select(*names, *[F.lit(v).cast("long").alias(k) for k, v in chosen.items()])
        else:
            plan = plan.join(F.broadcast(hot.select(*names)), names, "left_semi")
        self.plan = settle(plan.join(F.broadcast(self.facts.select(*names, "g")), names), "plan")
        sound = self.facts.filter(F.col("fault").isNull())
        known = F.broadcast(sound.select(*names, "g", "least_y", "most_y"))
        slots = [f"x{i}" for i in range(p)]
        told = rows.join(known, names).withColumn("q", F.when(F.col(HELD), 0).otherwise(grid(F.col("y"), F.col("least_y"), F.col("most_y"))).cast("long"))
        # However few files the table has, its rows are worked on by many tasks.
        told = told.repartition(task_count(rows.sparkSession, split.sizes.rows, LOCAL_ROWS))
        self.rows = settle(told.select("g", F.monotonically_increasing_id().alias("id"), HELD, ORDER, *slots, "y", "q"), "wide-rows")
        self.rounds = [self._round(keys, plan, seed, limit) for keys, plan in self._keys(sound)]

    def _keys(self, sound: DataFrame):
        """Keys in rounds of so many trees."""
        facts = sound.select("g", "num_rows", "held_rows", "least_y", "most_y").toPandas().set_index("g").sort_index()
        plan = self.plan.select("g", "trial", *HYPERPARAMETERS).toPandas()
        plan = plan[plan["g"].isin(facts.index)].sort_values(["g", "trial"])
        plan["max_depth"] = plan["max_depth"].astype(float).fillna(trees.NO_LIMIT).astype(np.int64)
        trees_of = plan.groupby(["g", "min_samples_leaf"])["n_estimators"].max().groupby("g").sum()
        number = (trees_of.cumsum() // TREES_AT_ONCE).reindex(facts.index)
        for _, keys in facts.groupby(number):
            yield keys, plan[plan["g"].isin(keys.index)]

    def _round(self, keys, plan, seed: int, limit: int):
        sparks = self.rows.sparkSession.sparkContext
        units = {"key": [], "leaf": [], "tree": [], "deepest": [], "smallest": []}
        limits, trials = {}, {}
        for (g, leaf), part in plan.groupby(["g", "min_samples_leaf"]):
            most = int(part["n_estimators"].max())
            for name, value in (("key", g), ("leaf", leaf), ("deepest", part["max_depth"].max()), ("smallest", part["min_samples_split"].min())):
                units[name].append(np.full(most, value))
            units["tree"].append(np.arange(most))
            limits[int(g), int(leaf)] = sorted({(int(d), int(s)) for d, s in zip(part["max_depth"], part["min_samples_split"])})
        for row in plan.itertuples():
            trials.setdefault(int(row.g), []).append((int(row.trial), int(row.min_samples_leaf), int(row.n_estimators), int(row.max_depth), int(row.min_samples_split)))
        arrays = {k: np.concatenate(v).astype(np.int64) for k, v in units.items()}
        span = {int(g): (float(a), float(b)) for g, a, b in zip(keys.index, keys["least_y"], keys["most_y"])}
        buckets = {int(g): max(1, -(-int(h) // SCORED)) for g, h in keys["held_rows"].items()}
        share = ((keys["num_rows"] - keys["held_rows"]) // SHARES).clip(upper=LOCAL_ROWS).clip(lower=limit)
        local = share.loc[arrays["key"]].to_numpy(np.int64)
        together = np.maximum(1, PIECE_ROWS // keys["num_rows"].loc[arrays["key"]].to_numpy(np.int64))
        piece = arrays["tree"] // together * together
        tops = Tops(**arrays, whole=np.zeros(len(arrays["key"]), bool), span=span, limits=limits, buckets=buckets, seed=seed, local=local, piece=piece)
        rows = self.rows.filter(F.col("g").between(int(keys.index.min()), int(keys.index.max())))
        lists = attribute_lists(rows.filter(~F.col(HELD)), self.p)
        grow_tops(lists, tops, self.p)

        told = sparks.broadcast(tops)
        slots = [f"x{i}" for i in range(self.p)]
        blocks = rows.mapInArrow(node_blocks(self.p, told, 4 * PAIRS_AT_ONCE), "g int, node long, " + "".join(f"{x} array<double>, " for x in slots) + ROW_ARRAYS)
        grown = blocks.groupBy("g", "node").applyInArrow(grown_rows(self.p, told), GROWN_TYPE)
        early = rows.filter(HELD).mapInArrow(leaf_votes(self.p, told), GROWN_TYPE)
        grown = settle(grown.unionByName(early), "grown")
        votes = grown.filter(F.col("bucket").isNotNull()).select("g", "bucket", "unit", "id", "y", "vote")
        failed = grown.filter(F.col("problem").isNotNull()).groupBy("g").agg(F.min("problem").alias("problem"))
        sure = votes.join(F.broadcast(failed.select("g")), "g", "left_anti")
        errors = sure.groupBy("g", "bucket").applyInArrow(bucket_errors(trials, told), ERRORS)
        n = F.sum("n")
        metrics = errors.groupBy("g", "trial").agg((F.sum("squares") / n).alias("mse"), (F.sum("gaps") / n).alias("mae"))
        return told, grown, settle(metrics, "errors"), settle(failed, "failed")

    def results(self) -> DataFrame:
        """The result rows of the bucket job for all trials, without models."""
        return self._listed(self.plan)

    def winners(self, best: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Result rows of the trials in ``best``, keys and trial, one per key; and the models of the good ones in pieces."""
        chosen = self.plan.join(best.select(*self.names, "trial"), [*self.names, "trial"], "left_semi")
        listed = settle(self._listed(chosen), "listed")
        good = listed.filter(F.col("status") == SUCCESS).select(*self.names)
        pieces = self.pieces(chosen.join(F.broadcast(good), self.names, "left_semi"))
        told = F.broadcast(self.facts.select(*self.names, "g"))
        return listed, pieces.join(told, "g").select(*self.names, PIECE, "model_bytes")

    def pieces(self, plan: DataFrame) -> DataFrame:
        """g, number and bytes of the pieces of the models of a plan that has one trial per key."""
        wanted = plan.select("g", "trial", *HYPERPARAMETERS)
        done = None
        for told, grown, _, _ in self.rounds:
            units = self._units(told, wanted)
            # Trees are few beside their nodes, so their list is broadcast; nodes are shuffled once, by the piece of their tree.
            nodes = grown.filter(F.col("feature").isNotNull()).join(F.broadcast(units.select("unit", PIECE)), "unit")
            nodes = nodes.select("g", PIECE, "unit", "node", "feature", "number", "value", "count")
            every = units.unionByName(nodes, allowMissingColumns=True)
            forests = every.groupBy("g", PIECE).applyInArrow(packed_forest(told), f"g int, {PIECE} int, model_bytes binary")
            done = forests if done is None else done.unionByName(forests)
        if done is None:
            return self.rows.sparkSession.createDataFrame([], f"g int, {PIECE} int, model_bytes binary")
        return done

    def _units(self, told, wanted: DataFrame) -> DataFrame:
        """The trees of the wanted trials: g, piece, unit and the limits."""
        known = told.value
        spark = wanted.sparkSession
        columns = {"g": known.key.astype(np.int32), "min_samples_leaf": known.leaf, "tree": known.tree, PIECE: known.piece.astype(np.int32), "unit": np.arange(len(known.key))}
        units = spark.createDataFrame(pa.table(columns))
        return units.join(F.broadcast(wanted), ["g", "min_samples_leaf"]).filter(F.col("tree") < F.col("n_estimators")).select("g", PIECE, "unit", "max_depth", "min_samples_split")

    def _listed(self, plan: DataFrame) -> DataFrame:
        from manyfold.operators.forest import result_schema

        metrics, failed = self._all(2), self._all(3)
        facts = self.facts.select("g", "num_rows", "fault")
        full = plan.join(facts, "g").join(metrics, ["g", "trial"], "left").join(failed, "g", "left")
        broken = F.when(F.col("problem").isNotNull(), F.concat(F.lit(ERROR), F.col("problem")))
        lost = F.when(F.col("mse").isNull(), F.lit(ERROR + "no tree could be grown"))
        full = full.withColumn("status", F.coalesce(F.col("fault"), broken, lost, F.lit(SUCCESS)))
        good = F.col("status") == SUCCESS
        result = full.select(
            *self.names,
            "trial",
            *HYPERPARAMETERS,
            F.lit(None).cast("binary").alias("model_bytes"),
            F.when(good, F.sqrt("mse")).alias("rmse"),
            F.when(good, F.col("mse")).alias("mse"),
            F.when(good, F.col("mae")).alias("mae"),
            "num_rows",
            "status",
        )
        return result.select(*[F.col(f.name).cast(f.dataType) for f in result_schema(self.code).fields])

    def _all(self, place: int) -> DataFrame:
        found = [r[place] for r in self.rounds]
        if not found:
            empty = "g int, trial long, mse double, mae double" if place == 2 else "g int, problem string"
            return self.rows.sparkSession.createDataFrame([], empty)
        whole = found[0]
        for part in found[1:]:
            whole = whole.unionByName(part)
        return whole
