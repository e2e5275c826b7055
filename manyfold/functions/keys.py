"""Keys that join without losing nulls.

``a <=> b`` joins are null-safe but partition by rewritten expressions, so rows that are already
partitioned by key would be shuffled again. Here a key is coded once into columns that are never
null: each key column with a stand-in for null, and a bit mask that tells stand-ins from values.
Plain equality on the coded columns is then null-safe, and one partitioning serves windows,
aggregates and joins alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MASK = "_kn"


def _stand_in(kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.lit(b"")
    if isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)):
        return F.lit("0").cast(kind)
    raise ValueError(f"cannot group by a column of type {kind.simpleString()}")


class KeyCode:
    """Coded key columns for ``keys`` of a table with this schema."""

    def __init__(self, schema: T.StructType, keys: list[str]):
        if not keys:
            raise ValueError("at least one key column is needed")
        absent = [k for k in keys if k not in schema.names]
        if absent:
            raise ValueError(f"missing key column(s) {absent}")
        self.keys = list(keys)
        self.kinds = [schema[k].dataType for k in keys]
        self.names = [f"_k{i}" for i in range(len(keys))] + [MASK]

    def coded(self) -> list[Column]:
        mask = F.lit(0)
        values = []
        for i, (key, kind) in enumerate(zip(self.keys, self.kinds)):
            c = F.col(key)
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                c = c + F.lit(0.0).cast(kind)  # minus zero and zero are one key
            values.append(F.coalesce(c, _stand_in(kind)).alias(f"_k{i}"))
            mask = mask + F.when(F.col(key).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
        return [*values, mask.cast("int").alias(MASK)]

    def restored(self) -> list[Column]:
        return [
            F.when(F.col(MASK).bitwiseAND(F.lit(1 << i)) == 0, F.col(f"_k{i}")).alias(key)
            for i, key in enumerate(self.keys)
        ]

    def fields(self) -> list[T.StructField]:
        coded = [T.StructField(f"_k{i}", kind) for i, kind in enumerate(self.kinds)]
        return [*coded, T.StructField(MASK, T.IntegerType())]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition over raw keys, nulls equal; for joins whose sides are not yet partitioned."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition
