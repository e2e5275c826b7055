"""Reproducible numbers: text hashes that any SQL engine with md5 repeats bit by bit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T


def _text(part) -> Column:
    c = part if isinstance(part, Column) else F.lit(str(part))
    return F.coalesce(c.cast("string"), F.lit("null"))


def order_hash(seed: int, *parts: Column) -> Column:
    """A 60-bit number from md5 of ``seed|part|part...``; sorts rows in a random but fixed order."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the same hash."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_text(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number by the Box-Muller rule over two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, *parts, F.lit("r"))))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(seed, *parts, F.lit("a")))


@dataclass(frozen=True)
class IntRange:
    """Whole numbers from ``low`` to ``high``, both included."""

    low: int
    high: int

    def __post_init__(self):
        if self.high < self.low:
            raise ValueError(f"empty range {self.low}..{self.high}")

    kind = T.LongType()

    def draw(self, u: Column) -> Column:
        return (F.lit(self.low) + F.floor(u * F.lit(float(self.high - self.low + 1)))).cast("long")


class Choice:
    """One of the listed values; ``None`` is a value like any other."""

    def __init__(self, *values):
        if not values:
            raise ValueError("a choice needs at least one value")
        self.values = list(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple)) else list(values)
        whole = all(v is None or isinstance(v, int) for v in self.values)
        self.kind = T.LongType() if whole else T.DoubleType()

    def draw(self, u: Column) -> Column:
        return self.value_at(F.floor(u * F.lit(float(len(self.values)))).cast("int"))

    def value_at(self, index: Column) -> Column:
        options = F.array(*[F.lit(v).cast(self.kind) for v in self.values])
        return F.element_at(options, (index + F.lit(1)).cast("int"))

    def index_of(self, value: Column) -> Column:
        index = F.lit(None).cast("int")
        for i, v in reversed(list(enumerate(self.values))):
            index = F.when(value.eqNullSafe(F.lit(v).cast(self.kind)), F.lit(i)).otherwise(index)
        return index
