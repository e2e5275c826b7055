"""Centred sums for many features.

One aggregate expression per pair of features is the fastest way for a few of them, but their number grows
with the square. Here rows sorted by key stream through a task that keeps the sums of one group at a time
and adds them a batch at a time; the sums of a group that lies in several tasks are merged in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from manyfold.operators.split import HELD

SIDES = ("fit", "held")
NUMBERS = T.ArrayType(T.DoubleType())


class Sums:
    """Count, means and centred products of the columns (x0.., y) of one set of rows."""

    def __init__(self, n: int, mean: np.ndarray, product: np.ndarray):
        self.n, self.mean, self.product = n, mean, product

    @classmethod
    def of(cls, z: np.ndarray) -> Sums:
        if not len(z):
            return cls(0, np.zeros(z.shape[1]), np.zeros((z.shape[1], z.shape[1])))
        mean = z.mean(axis=0)
        centred = z - mean
        return cls(len(z), mean, centred.T @ centred)

    def plus(self, other: Sums) -> Sums:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        product = self.product + other.product + np.outer(gap, gap) * (self.n * other.n / n)
        return Sums(n, self.mean + gap * (other.n / n), product)


def _runs(batch: pa.RecordBatch, names: list[str]) -> list[tuple[int, int]]:
    n = batch.num_rows
    changed = np.zeros(n, bool)
    changed[0] = True
    for name in names:
        column = batch.column(name)
        changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(changed)
    return list(zip(begin, np.append(begin[1:], n)))


def _stream(names: list[str], schema: T.StructType, read, told):
    """Add up the sums of consecutive runs with one key.

    ``read`` turns a batch into a function of a run; ``told`` gives the output values of one sum.
    """
    target = to_arrow_schema(schema)

    def emit(done):
        keys = [pa.array([k[i] for k, _ in done], target.field(n).type) for i, n in enumerate(names)]
        values = list(zip(*[[v for total in sums for v in told(total)] for _, sums in done]))
        types = [f.type for f in target][len(names):]
        return pa.RecordBatch.from_arrays(keys + [pa.array(v, t) for v, t in zip(values, types)], schema=target)

    def run(batches):
        key, total = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            take = read(batch)
            done = []
            for a, b in _runs(batch, names):
                here = tuple(batch.column(n)[int(a)].as_py() for n in names)
                found = take(a, b)
                if here == key:
                    total = [t.plus(f) for t, f in zip(total, found)]
                else:
                    if key is not None:
                        done.append((key, total))
                    key, total = here, found
            if done:
                yield emit(done)
        if key is not None:
            yield emit([(key, total)])

    return run


def _read_rows(p: int):
    columns = [*[f"x{i}" for i in range(p)], "y"]

    def read(batch):
        z = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
        held = batch.column(HELD).to_numpy(zero_copy_only=False).astype(bool)
        whole = ~np.isnan(z).any(axis=1)

        def take(a, b):
            part, side, ok = z[a:b], held[a:b], whole[a:b]
            return [Sums.of(part[ok & ~side]), Sums.of(part[ok & side])]

        return take

    return read


def _read_sums(width: int):
    def read(batch):
        columns = [[batch.column(f"{s}_{c}") for c in ("n", "mean", "product")] for s in SIDES]

        def one(side, i):
            n, mean, product = (c[int(i)].as_py() for c in columns[side])
            return Sums(n, np.array(mean), np.array(product).reshape(width, width))

        def take(a, b):
            total = [one(0, a), one(1, a)]
            for i in range(a + 1, b):
                total = [t.plus(one(s, i)) for s, t in enumerate(total)]
            return total

        return take

    return read


def _schema(rows: DataFrame, names: list[str], columns: dict[str, T.DataType]) -> T.StructType:
    sides = [T.StructField(f"{side}_{c}", kind) for side in SIDES for c, kind in columns.items()]
    return T.StructType([rows.schema[n] for n in names] + sides)


def streamed_moments(rows: DataFrame, names: list[str], p: int, hot: bool) -> DataFrame:
    """Keys and the columns that :func:`manyfold.operators.linear.moments` makes, for both sides of the split.

    Cold rows arrive partitioned and sorted by key, so each group is one run of one task.
    """
    partial = _schema(rows, names, {"n": T.LongType(), "mean": NUMBERS, "product": NUMBERS})
    final = _schema(
        rows,
        names,
        {"n": T.LongType(), "mean": NUMBERS, "ymean": T.DoubleType(), "cxx": NUMBERS, "cxy": NUMBERS, "cyy": T.DoubleType()},
    )
    upper = np.triu_indices(p)

    def parts(total: Sums):
        return total.n, total.mean, total.product.ravel()

    def moments(total: Sums):
        c = total.product / max(total.n, 1)
        return total.n, total.mean[:p], total.mean[p], c[:p, :p][upper], c[:p, p], c[p, p]

    needed = rows.select(*names, *[f"x{i}" for i in range(p)], "y", HELD).sortWithinPartitions(*names)
    if not hot:
        return needed.mapInArrow(_stream(names, final, _read_rows(p), moments), final)
    sums = needed.mapInArrow(_stream(names, partial, _read_rows(p), parts), partial)
    sums = sums.repartition(*names).sortWithinPartitions(*names)
    return sums.mapInArrow(_stream(names, final, _read_sums(p + 1), moments), final)
