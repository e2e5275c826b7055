"""Running totals within groups of any size.

A window would pull a whole group into one task. Here the rows are range-partitioned by group and order;
each piece is summed by itself and shifted by the totals of the pieces before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from manyfold.sources.settled import settle


def running_totals(df: DataFrame, group: list[str], order: str, totals: dict[str, str]) -> DataFrame:
    """For each ``out: value`` the sum of ``value`` over the rows before this one in its group.

    ``order`` has no equals within a group.
    """
    pieces = settle(df.repartitionByRange(*group, order).withColumn("_piece", F.spark_partition_id()), "running")
    sums = pieces.groupBy(*group, "_piece").agg(*[F.sum(v).alias(f"_sum_{out}") for out, v in totals.items()])
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group, "_piece", *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_{out}") for out in totals]
    )
    inside = Window.partitionBy(*group, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = pieces.withColumns({out: F.coalesce(F.sum(v).over(inside), F.lit(0)) for out, v in totals.items()})
    joined = summed.join(settle(offsets, "running"), [*group, "_piece"])
    return joined.withColumns({out: F.col(out) + F.col(f"_{out}") for out in totals}).drop(
        "_piece", *[f"_{out}" for out in totals]
    )
