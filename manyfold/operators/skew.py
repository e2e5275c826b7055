"""Finding the groups that are too large for one task, and spreading copies over tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from manyfold.functions.keys import KeyCode

# At most this many groups can reach 1/MAX_HOT of all rows, which bounds every broadcast of hot keys.
MAX_HOT = 250_000


@dataclass(frozen=True)
class Sizes:
    """Total row and group counts, the row count that makes a group hot, and the hot groups if any."""

    rows: int
    groups: int
    limit: int
    hot: DataFrame | None  # coded keys, n, parts; never more than MAX_HOT rows

# More tasks than this cost the scheduler more than they give.
MAX_TASKS = 100_000


def task_count(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Enough tasks to keep all cores busy, and more when the rows would not fit them."""
    return min(MAX_TASKS, max(4 * spark.sparkContext.defaultParallelism, -(-rows // rows_per_task)))


def group_sizes(df: DataFrame, code: KeyCode) -> DataFrame:
    return df.select(*code.coded()).groupBy(*code.names).agg(F.count(F.lit(1)).alias("n"))


def measure(df: DataFrame, code: KeyCode, rows_per_task: int) -> Sizes:
    """One pass over the key columns alone. A group is hot above ``rows_per_task`` rows."""
    sizes = group_sizes(df, code)
    total = sizes.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.max("n").alias("top")).first()
    rows, top = total.n or 0, total.top or 0
    limit = max(rows_per_task, -(-rows // MAX_HOT))
    hot = None
    if top > limit:
        hot = sizes.filter(F.col("n") > limit).withColumn("parts", F.ceil(F.col("n") / F.lit(rows_per_task)))
    return Sizes(rows, total.g, limit, hot)


def without(rows: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    return rows.join(F.broadcast(groups.select(*names)), names, "left_anti")


def only(rows: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the listed groups with the columns of the list; the list is bounded by ``measure``."""
    return rows.join(F.broadcast(groups), names)


def spread_copies(df: DataFrame, count: str, chunk: int = 100_000) -> DataFrame:
    """Turn a row with a count back into that many rows, made by many tasks when the count is large."""
    others = [c for c in df.columns if c != count]
    last = F.floor((F.col(count) - 1) / F.lit(chunk))
    chunks = df.filter(F.col(count) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    spread = chunks.repartition(*others, "_chunk")
    size = F.least(F.lit(chunk).cast("long"), F.col(count) - F.col("_chunk") * F.lit(chunk))
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*others)
