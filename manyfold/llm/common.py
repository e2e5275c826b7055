"""What several operators share: row keys, lookups that survive hot keys, bit sets of a fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# At most this many keys can each hold more than this share of the rows, so a list of them can be broadcast.
SHARES = 1000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet, whatever columns came with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_digest(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The frame with a digest of its text: with the id it names a row even if ids repeat or are null."""
    name = fresh(df, "text_digest")
    return df.withColumn(name, F.xxhash64(F.coalesce(F.col(text), F.lit("")))), name


def lookup(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], count: str, spread: str) -> DataFrame:
    """Left join with a table that has each key once and, in ``count``, its number of rows on the left.

    Keys with more than 1/1000 of the rows, fewer than 2000 by construction, are broadcast. Their rows, and those
    with a null key, go on under a salt of column ``spread``, so the join by shuffle gets no hot key.
    """
    limit = (right.agg(F.sum(count)).first()[0] or 0) // SHARES
    value = F.struct(*values)
    heavy = right.filter(F.col(count) > limit).select(*keys, value.alias("heavy_"))
    light = right.filter(F.col(count) <= limit).select(*keys, value.alias("light_"), F.lit(0).cast("long").alias("salt_"))
    bare = F.lit(False)
    for k in keys:
        bare = bare | F.col(k).isNull()
    aside = F.col("heavy_").isNotNull() | bare
    salted = left.join(F.broadcast(heavy), keys, "left").withColumn(
        "salt_", F.when(aside, F.xxhash64(spread).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))
    )
    found = salted.join(light, [*keys, "salt_"], "left").withColumn("found_", F.coalesce("heavy_", "light_"))
    return found.select(*left.columns, *[F.col(f"found_.{v}").alias(v) for v in values])


def hot_keys(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The keys with more than 1/1000 of all rows, fewer than 2000: a list to broadcast."""
    limit = (counts.agg(F.sum(count)).first()[0] or 0) // SHARES
    return counts.filter(F.col(count) > limit).select(*keys, F.lit(True).alias("hot_"))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, hot: DataFrame, how: str = "inner", salts: int = 256) -> DataFrame:
    """Join in which the rows on the left of every hot key are dealt to many tasks by a hash of ``spread``.

    ``hot`` comes from ``hot_keys`` over the rows on the left. Only hot rows on the right are repeated. No key is null.
    """
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    some = left.join(hot, keys, "left").withColumn("salt_", F.when(F.col("hot_"), salt).otherwise(0)).drop("hot_")
    last = F.when(F.col("hot_"), salts - 1).otherwise(0)
    many = right.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), last))).drop("hot_")
    return some.join(many, [*keys, "salt_"], how).drop("salt_")


def bit_set(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of the low ``bits`` bits of hashes, as 64-bit words: 2**bits / 8 bytes however many hashes there are."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        hashes.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    filled = np.zeros(1 << (bits - 6), np.uint64)
    rows = words.toPandas()
    filled[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return filled


def in_bit_set(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(words) * 64 - 1)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """The condition that pairs of columns agree, two nulls included."""
    agree = F.lit(True)
    for a, b in pairs:
        agree = agree & left[a].eqNullSafe(right[b])
    return agree
