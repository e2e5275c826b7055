"""A random forest per group.

Whole groups are dealt into buckets, and one task grows the forests of all keys of its bucket at once;
the cost per key is arithmetic, not a Python call per key. Groups too large for a bucket are grown by
:mod:`manyfold.operators.forest_wide` on sorted lists that are dealt over the cluster.
Both ways draw the same bootstrap weights, try every split and compare the same exact sums, so they give
the same trees.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from manyfold.functions import guided, trees
from manyfold.functions.keys import KeyCode
from manyfold.operators.split import BUCKET, HELD, ORDER, SplitRows, bucket_by_key
from manyfold.schema import ERROR, HYPERPARAMETERS, SUCCESS, TOO_SMALL, conform
from manyfold.sources.pieces import PIECE, Pieced

# What a plan calls its key when more trials are to be drawn from it.
LABEL = "_label"

# Pairs of a row and a tree that are grown together in one task; bounds the memory of a bucket job.
PAIRS_AT_ONCE = 150_000

# What is known of a grown node.
NODE = ("group", "tree", "feature", "threshold", "left", "value", "depth", "count")


@dataclass(frozen=True)
class ForestSettings:
    n_estimators: int = 50
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1

    def __post_init__(self):
        if self.n_estimators < 1 or self.min_samples_split < 2 or self.min_samples_leaf < 1:
            raise ValueError(f"not a forest: {self}")


def result_schema(code: KeyCode) -> T.StructType:
    """What a bucket job returns per key and trial."""
    whole = [T.StructField(n, T.LongType()) for n in ("trial", *HYPERPARAMETERS)]
    metrics = [T.StructField(n, T.DoubleType()) for n in ("rmse", "mse", "mae")]
    return T.StructType(
        code.fields()
        + whole
        + [T.StructField("model_bytes", T.BinaryType())]
        + metrics
        + [T.StructField("num_rows", T.LongType()), T.StructField("status", T.StringType())]
    )


def group_faults(group, count, y, x, min_rows):
    """Status of groups that cannot be fitted, by the same rules as the linear path; None where all is well."""
    def any_in(rows):
        return np.bincount(group[rows], minlength=len(count)) > 0

    status = np.full(len(count), None, object)
    status[any_in(np.isinf(y) | np.isinf(x).any(axis=0))] = ERROR + "value is not finite"
    status[any_in(np.isnan(x).any(axis=0))] = ERROR + "missing feature"
    status[any_in(np.isnan(y))] = ERROR + "missing target"
    status[count < min_rows] = TOO_SMALL
    return status


class BucketFit:
    """Train rows and validation rows of the sound groups of one bucket, ready to grow trees."""

    def __init__(self, group, x, y, order_hash, held, seed, groups):
        fit = ~held
        self.seed, self.groups = seed, groups
        self.group, self.hash = group[fit], order_hash[fit]
        self.low = np.full(groups, np.inf)
        self.high = np.full(groups, -np.inf)
        np.minimum.at(self.low, self.group, y[fit])
        np.maximum.at(self.high, self.group, y[fit])
        g = self.group
        self.grid = trees.on_grid(y[fit], self.low[g], self.high[g])
        self.bins, self.values = zip(*[trees.bin_rows(g, column[fit]) for column in x])
        self.held_group, self.held_x, self.held_y = group[held], x[:, held], y[held]
        self.kept = None

    def grow(self, first, last, most, max_depth, min_split, min_leaf, done=0):
        """The nodes of the trees ``first`` up to ``last``, and the root of each by tree and group.

        A group has ``most`` trees, of which it lacks those from ``done`` on; it is -1 where a root is not wanted.
        """
        wanted = (np.arange(first, last)[:, None] >= done) & (np.arange(first, last)[:, None] < most)
        rows = np.flatnonzero(wanted.any(axis=0)[self.group])
        group, repeats = self.group[rows], last - first
        weights = trees.row_weights(self.hash[rows], self.seed, first, last)
        weights = trees.without_empty_trees(weights, group, self.groups)
        weights[~wanted[:, group]] = 0
        unit, row, w, orders = trees.tree_pairs(weights, group, [b[rows] for b in self.bins], self.groups)
        row = rows[row]
        q = self.grid[row]
        limits = np.tile(max_depth, repeats), np.tile(min_split, repeats)
        high, low = trees.halves(q)
        nodes = trees.grow(unit, row, self.bins, orders, w, w * high, w * low, q, q, np.ones_like(w), *limits, min_leaf)
        inner = np.flatnonzero(nodes["feature"] >= 0)
        f = nodes["feature"][inner]
        nodes["threshold"] = np.zeros(len(nodes["owner"]))
        values = np.array(self.values)
        nodes["threshold"][inner] = trees.midpoint(values[f, nodes["below"][inner]], values[f, nodes["above"][inner]])
        g = nodes["owner"] % self.groups
        nodes["value"] = trees.off_grid(nodes["high"], nodes["low"], nodes["weight"], self.low[g], self.high[g])
        roots = np.full(repeats * self.groups, -1, np.int64)
        top = np.flatnonzero(nodes["depth"] == 0)
        roots[nodes["owner"][top]] = top
        nodes["group"], nodes["tree"] = g, nodes["owner"] // self.groups + first
        return {n: nodes[n] for n in NODE}, roots.reshape(repeats, self.groups)

    def keep(self, whole: bool):
        """Grow no tree twice from now on: trials and winners are read from the trees that are kept.

        Trees are kept ``whole`` where later trials may have looser limits than the first.
        """
        self.kept, self.whole = {}, whole

    def _kept(self, leaf, most, depth, split):
        """The kept trees of a leaf size, after those were added that a group lacks."""
        if self.whole:
            depth, split = np.full(self.groups, trees.NO_LIMIT), np.full(self.groups, 2)
        nodes, roots, done = self.kept.get(leaf, (None, np.zeros((0, self.groups), np.int64), np.zeros(self.groups, np.int64)))
        lacking = most > done
        if lacking.any():
            first, last = int(done[lacking].min()), int(most.max())
            more, tops = self.grow(first, last, np.where(lacking, most, 0), depth, split, leaf, done)
            base = 0 if nodes is None else len(nodes["left"])
            if base:
                more["left"] = np.where(more["left"] >= 0, more["left"] + base, -1)
                more = {n: np.concatenate([nodes[n], more[n]]) for n in NODE}
            nodes = more
            roots = np.concatenate([roots, np.full((max(0, last - len(roots)), self.groups), -1, np.int64)])
            roots[first:last] = np.where(tops >= 0, tops + base, roots[first:last])
            self.kept[leaf] = nodes, roots, np.maximum(done, most)
        return nodes, roots

    def run(self, plan: pd.DataFrame, keep_models: bool):
        """Hold-out metrics of every planned (group, trial), and the forests when asked for.

        Trials of a group that share ``min_samples_leaf`` share their trees: depth and split limits only
        end a branch sooner, so the trees are grown to the loosest limit and read under each trial's own.
        """
        mse, mae = np.full(len(plan), np.nan), np.full(len(plan), np.nan)
        models = np.full(len(plan), None, object)
        for leaf, part in plan.groupby("min_samples_leaf"):
            entries = part.index.to_numpy()
            owner = part["group"].to_numpy()
            sizes = part["n_estimators"].to_numpy()
            depth = part["max_depth"].fillna(trees.NO_LIMIT).to_numpy(np.int64)
            split = part["min_samples_split"].to_numpy()
            most, deepest = np.zeros(self.groups, np.int64), np.zeros(self.groups, np.int64)
            smallest = np.full(self.groups, trees.NO_LIMIT, np.int64)
            np.maximum.at(most, owner, sizes)
            np.maximum.at(deepest, owner, depth)
            np.minimum.at(smallest, owner, split)
            # One case is one validation row under one trial.
            order = np.argsort(self.held_group, kind="stable")
            begin = np.searchsorted(self.held_group[order], owner, "left")
            width = np.searchsorted(self.held_group[order], owner, "right") - begin
            case = np.repeat(np.arange(len(part)), width)
            within = np.arange(len(case)) - np.repeat(np.cumsum(width) - width, width)
            row = order[begin[case] + within]
            total, votes = np.zeros(len(case)), np.zeros(len(case), np.int64)
            limits = None
            if self.kept is not None or len(np.unique(owner)) < len(owner):
                limits = depth, split
            step = max(1, PAIRS_AT_ONCE // max(1, len(self.group), len(case)))
            grown = []
            for first in range(0, int(most.max(initial=0)), step):
                last = min(first + step, int(most.max()))
                if self.kept is None:
                    nodes, roots = self.grow(first, last, most, deepest, smallest, int(leaf))
                else:
                    nodes, roots = self._kept(int(leaf), most, deepest, smallest)
                    roots = roots[first:last]
                self._vote(nodes, roots, first, case, row, owner, sizes, limits, total, votes)
                if keep_models and self.kept is None:
                    # A forest is kept without the sums and limits that it was grown by.
                    number = np.where(nodes["feature"] >= 0, nodes["threshold"], nodes["value"])
                    whole = [nodes[n] for n in ("group", "tree", "feature", "left")]
                    grown.append((*(a.astype(np.int32) for a in whole), number))
            with np.errstate(invalid="ignore", divide="ignore"):
                gap = self.held_y[row] - total / votes
            mse[entries] = np.bincount(case, gap * gap, len(part)) / width
            mae[entries] = np.bincount(case, np.abs(gap), len(part)) / width
            if keep_models:
                if self.kept is not None:
                    grown.append(self._cut(*self._kept(int(leaf), most, deepest, smallest), most, deepest, smallest))
                models[entries] = self._packed(grown, owner)
        return mse, mae, models

    def search(self, plan: pd.DataFrame, search: guided.Search):
        """The planned trials, then round after round the one that each group's history proposes.

        Gives the best trial of every group, the first of equals, and its fit; a missing error loses.
        """
        label = plan.drop_duplicates("group").set_index("group")[LABEL]
        tried = plan.assign(rmse=np.sqrt(self.run(plan, False)[0]))
        codes = {n: [search.code(n, v) for v in plan[n]] for n in search.space}
        seen = [{n: [] for n in (*search.space, "rmse")} for _ in range(self.groups)]

        def remember(part, coded):
            for k, (g, error) in enumerate(zip(part["group"], part["rmse"])):
                seen[g]["rmse"].append(error)
                for n in search.space:
                    seen[g][n].append(coded[n][k])

        remember(tried, codes)
        for trial in search.rounds:
            drawn = []
            for g in label.index:
                past = {n: np.array(v) for n, v in seen[g].items()}
                drawn.append({"group": g, "trial": trial, **search.propose(past, past["rmse"], label[g], trial, self.seed)})
            part = pd.DataFrame(drawn)
            part["max_depth"] = part["max_depth"].astype(float)
            part["rmse"] = np.sqrt(self.run(part, False)[0])
            remember(part, {n: [search.code(n, v) for v in part[n]] for n in search.space})
            tried = pd.concat([tried, part], ignore_index=True)
        best = tried.sort_values(["group", "rmse", "trial"], na_position="last").drop_duplicates("group")
        best = best.reset_index(drop=True)
        return best, self.run(best, True)

    def _vote(self, nodes, roots, first, case, row, owner, sizes, limits, total, votes):
        """Add the predictions of the trees from ``first`` on, tree after tree, to the totals of the cases."""
        trees_of = np.arange(len(roots))[:, None]
        at = roots[:, owner[case]]
        takes = np.flatnonzero((at >= 0) & (trees_of + first < sizes[case]))
        chosen = takes % len(case) if len(case) else takes
        may_split = None
        if limits is not None:
            depth, split = (a[case[chosen]] for a in limits)

            def may_split(node, active):
                return (nodes["depth"][node] < depth[active]) & (nodes["count"][node] >= split[active])
        leaf = trees.walk(
            nodes["feature"], nodes["threshold"], nodes["left"], at.ravel()[takes], row[chosen], self.held_x, may_split
        )
        said = np.zeros(at.shape)
        said.ravel()[takes] = nodes["value"][leaf]
        # One tree after the other, so that a total does not depend on how many trees are at hand at once.
        for tree in said:
            total += tree
        votes += np.bincount(chosen, minlength=len(case))

    def _cut(self, nodes, roots, most, depth, split):
        """What a group's limits leave of its first ``most`` trees, in the order in which the nodes lie."""
        g = nodes["group"]
        inner = (nodes["feature"] >= 0) & (nodes["depth"] < depth[g]) & (nodes["count"] >= split[g])
        front = roots[(np.arange(len(roots))[:, None] < most) & (roots >= 0)]
        reached = np.zeros(len(g), bool)
        while len(front):
            reached[front] = True
            left = nodes["left"][front[inner[front]]]
            front = np.concatenate([left, left + 1])
        at = np.flatnonzero(reached)
        inner = inner[at]
        left = np.where(inner, (np.cumsum(reached) - 1)[nodes["left"][at]], -1)
        number = np.where(inner, nodes["threshold"][at], nodes["value"][at])
        whole = (g[at], nodes["tree"][at], np.where(inner, nodes["feature"][at], -1), left)
        return (*(a.astype(np.int32) for a in whole), number)

    def _packed(self, grown, owner):
        """The forest of each group as bytes, its nodes in order of tree and level."""
        columns = {k: [] for k in ("group", "tree", "feature", "left", "number")}
        base = 0
        for part in grown:
            for name, values in zip(columns, part):
                columns[name].append(np.where(values >= 0, values + np.int32(base), np.int32(-1)) if name == "left" else values)
            base += len(part[0])
        # The parts are not needed beside the whole.
        grown.clear()
        c = {k: np.concatenate(columns.pop(k)) if base else np.zeros(0, np.int64) for k in list(columns)}
        order = np.argsort(c["group"].astype(np.int64) * (1 + c["tree"].max(initial=0)) + c["tree"], kind="stable")
        place = np.empty(base, np.int64)
        place[order] = np.arange(base)
        group, tree = c["group"][order], c["tree"][order]
        begin = np.searchsorted(group, np.arange(self.groups), "left")
        end = np.searchsorted(group, np.arange(self.groups), "right")
        left = c["left"][order]
        left = np.where(left >= 0, place[left] - begin[group], -1)
        is_root = np.append(True, (group[1:] != group[:-1]) | (tree[1:] != tree[:-1])) if base else np.zeros(0, bool)
        feature, number = c["feature"][order], c["number"][order]
        return [
            trees.pack(feature[a:b], number[a:b], left[a:b], np.flatnonzero(is_root[a:b])) if b > a else None
            for a, b in zip(begin[owner], end[owner])
        ]


def _rows_of(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A group number per row, and the first row of each group."""
    frame = table.select(names).to_pandas()
    group = frame.groupby(names, sort=False).ngroup().to_numpy()
    first = np.unique(group, return_index=True)[1]
    return group, first


def _doubles(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).to_pandas()
    return column.to_numpy(dtype=float, na_value=np.nan)


def fit_bucket(table, plan_table, names, p, settings, min_rows, seed, keep_models, schema, search=None):
    """Fit every group of a bucket; what fails is halved and run again, until a group that cannot be fitted is alone.

    With a search the plan has the first trials of each group, and the result only the best of all.
    """
    group, first = _rows_of(table, names)
    x = np.array([_doubles(table, f"x{i}") for i in range(p)])
    y, order_hash = _doubles(table, "y"), table.column(ORDER).to_numpy()
    held = table.column(HELD).to_pandas().to_numpy(bool)
    by = np.lexsort((y, *x[::-1], order_hash, group))
    group, x, y, order_hash, held = group[by], x[:, by], y[by], order_hash[by], held[by]
    count = np.bincount(group)
    status = group_faults(group, count, y, x, min_rows)
    keys = table.select(names).take(pa.array(first))
    if plan_table is None:
        plan = pd.DataFrame({"group": np.arange(len(count)), "trial": 0, **settings})
        plan["max_depth"] = plan["max_depth"].astype(float)
    else:
        numbered = keys.to_pandas().assign(group=np.arange(len(count)))
        plan = plan_table.to_pandas().merge(numbered, on=names).drop(columns=names)
        plan = plan.sort_values(["group", "trial"]).reset_index(drop=True)
    trials = plan
    if search is not None:
        plan = plan.drop_duplicates("group").reset_index(drop=True)
    mse, mae = np.full(len(plan), np.nan), np.full(len(plan), np.nan)
    models = np.full(len(plan), None, object)

    most_trees = int(trials["n_estimators"].max()) if search is None else search.most_trees()

    def fit(chosen):
        renumber = np.full(len(count), -1)
        renumber[chosen] = np.arange(len(chosen))
        rows = np.flatnonzero(renumber[group] >= 0)
        work = BucketFit(
            renumber[group[rows]], x[:, rows], y[rows], order_hash[rows], held[rows], seed, len(chosen)
        )
        entries = np.flatnonzero(renumber[plan["group"]] >= 0)
        part = trials[renumber[trials["group"]] >= 0].reset_index(drop=True)
        part["group"] = renumber[part["group"]]
        if search is None:
            mse[entries], mae[entries], models[entries] = work.run(part, keep_models)
            return
        if len(rows) * most_trees <= PAIRS_AT_ONCE:
            work.keep(len(search.rounds) > 0)
        best, (mse[entries], mae[entries], models[entries]) = work.search(part, search)
        for column in ("trial", *HYPERPARAMETERS):
            plan.loc[entries, column] = best[column].to_numpy()

    def attempt(chosen):
        try:
            fit(chosen)
        except Exception as problem:
            if len(chosen) == 1:
                status[chosen[0]] = f"{ERROR}{problem}"
                return
            middle = len(chosen) // 2
            attempt(chosen[:middle])
            attempt(chosen[middle:])

    sound = np.flatnonzero([s is None for s in status])
    if len(sound):
        # Groups whose trees fit together are grown together, all trees at once.
        part = (np.cumsum(count[sound]) * most_trees - 1) // PAIRS_AT_ONCE
        for piece in np.split(sound, np.flatnonzero(np.diff(part)) + 1):
            attempt(piece)
    owner = plan["group"].to_numpy()
    said = np.array([s if s is not None else SUCCESS for s in status], object)[owner]
    said[(said == SUCCESS) & np.isnan(mse)] = ERROR + "no tree could be grown"
    good = said == SUCCESS
    columns = {n: keys.column(n).take(pa.array(owner)) for n in names}
    columns["trial"] = pa.array(plan["trial"].to_numpy(np.int64))
    for h in HYPERPARAMETERS:
        columns[h] = pa.array(plan[h].to_numpy(float), from_pandas=True).cast(pa.int64())
    columns["model_bytes"] = pa.array(np.where(good, models, None), pa.binary())
    with np.errstate(invalid="ignore"):
        for name, values in (("rmse", np.sqrt(mse)), ("mse", mse), ("mae", mae)):
            columns[name] = pa.array(values, mask=~good)
    columns["num_rows"] = pa.array(count[owner])
    columns["status"] = pa.array(said, pa.string())
    target = to_arrow_schema(schema)
    return pa.table([columns[f.name].cast(f.type) for f in target], schema=target)


def fit_buckets(split: SplitRows, p, settings, plan, min_rows, seed, keep_models, search=None) -> DataFrame:
    """Run the bucket job over the cold groups, with constant settings, a plan per key and trial, or a search."""
    names, schema = split.code.names, result_schema(split.code)
    constants = asdict(settings) if settings else None

    def alone(table: pa.Table) -> pa.Table:
        return fit_bucket(table, None, names, p, constants, min_rows, seed, keep_models, schema)

    def planned(table: pa.Table, trials: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({f.name: pa.array([], f.type) for f in to_arrow_schema(schema)})
        return fit_bucket(table, trials, names, p, None, min_rows, seed, keep_models, schema, search)

    rows = split.cold.groupBy(BUCKET)
    if plan is None:
        return rows.applyInArrow(alone, schema)
    trials = bucket_by_key(plan, names, split.buckets, split.tasks).groupBy(BUCKET)
    return rows.cogroup(trials).applyInArrow(planned, schema)


def wide_fit(split: SplitRows, p, settings, plan, min_rows, seed):
    from manyfold.operators.forest_wide import WideFit

    return WideFit(split, p, settings, plan, min_rows, seed, split.sizes.limit)


def model_rows(results: DataFrame, split: SplitRows, features: list[str], params: list[str] = ()) -> DataFrame:
    good = F.col("status") == SUCCESS
    names = F.array(*[F.lit(f) for f in features])
    return results.select(
        *split.code.restored(),
        "model_bytes",
        F.when(good, names).alias("feature_names"),
        "rmse",
        "mse",
        "mae",
        "num_rows",
        *[F.when(good, F.col(c)).alias(c) for c in params],
        "status",
    )


def model_table(cold: DataFrame, hot: tuple[DataFrame, DataFrame] | None, split: SplitRows, features: list[str], schema, params: list[str] = ()) -> DataFrame:
    """The table of models; those of hot groups come as result rows and as pieces of models."""

    def told(results: DataFrame) -> DataFrame:
        return conform(model_rows(results, split, features, params), schema)

    if hot is None:
        return told(cold)
    slim, pieces = hot
    return Pieced(told(cold), told(slim), pieces.select(*split.code.restored(), PIECE, "model_bytes"), split.code.keys).models()


def train_forest(split: SplitRows, features, settings: ForestSettings, min_rows, seed, schema) -> DataFrame:
    p = len(features)
    cold = fit_buckets(split, p, settings, None, min_rows, seed, True)
    hot = None
    if split.hot is not None:
        fit = wide_fit(split, p, settings, None, min_rows, seed)
        hot = fit.winners(fit.plan.select(*split.code.names, "trial"))
    return model_table(cold, hot, split, features, schema)


def evaluate_forest_trials(split: SplitRows, plan: DataFrame, features, min_rows, seed) -> DataFrame:
    """Coded keys, trial, settings, metrics and status of every key and trial, hot or cold."""
    p = len(features)
    cold = fit_buckets(split, p, None, plan, min_rows, seed, False)
    return cold if split.hot is None else cold.unionByName(wide_fit(split, p, None, plan, min_rows, seed).results())
