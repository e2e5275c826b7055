"""Observations in one fixed shape, and the seeded hold-out split of every group.

The split ranks the rows of a group by an md5 number of their row key, so it depends neither on the
order nor on the partitioning of the input. Groups that fit a task are ranked by a window. For hot
groups no row is ranked or moved: counts per hash range find the one hash that parts validation from
training, and every row is then compared with the hash of its group where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from manyfold.functions.draws import order_hash
from manyfold.functions.features import check_columns, check_numeric, filled
from manyfold.functions.keys import KeyCode
from manyfold.operators.running import running_totals
from manyfold.operators.skew import Sizes, measure, only, spread_copies, task_count, without
from manyfold.sources.settled import settle

ORDER = "_h"
HELD = "_held"  # true on validation rows
BUCKET = "_bucket"  # many whole groups that one task works on together


@dataclass(frozen=True)
class SplitRows:
    """Coded keys, x0.., y, the order hash and the validation flag; hot groups stand apart."""

    cold: DataFrame
    hot: DataFrame | None
    code: KeyCode
    sizes: Sizes
    groups: DataFrame  # coded keys, one row per group
    buckets: int = 0  # when set, cold rows carry their bucket and are partitioned by it
    tasks: int = 0

    def parts(self) -> list[tuple[DataFrame, bool]]:
        return [(self.cold, False)] + ([(self.hot, True)] if self.hot is not None else [])

    def rows(self) -> DataFrame:
        return self.cold if self.hot is None else self.cold.unionByName(self.hot, allowMissingColumns=True)


def feature_slots(features: list[str]) -> list[str]:
    return [f"x{i}" for i in range(len(features))]


def observations(
    keyed: DataFrame, names: list[str], target: str, features: list[str], row_key: list[str], seed: int, fill: float | None
) -> DataFrame:
    """Only the columns a training needs, so that nothing else is shuffled: keys, x0.., y and the order hash."""
    slots = [filled(F.col(c), fill).alias(x) for c, x in zip(features, feature_slots(features))]
    hashed = order_hash(seed, *[F.col(c) for c in row_key]).alias(ORDER)
    return keyed.select(*names, *slots, F.col(target).cast("double").alias("y"), hashed)


def held_count(n: Column, fraction: float) -> Column:
    return F.ceil(F.lit(float(fraction)) * n)


# Rows that a bucket job holds at a time, unless a single group has more.
ROWS_PER_BUCKET = 50_000


def bucket_by_key(rows: DataFrame, names: list[str], buckets: int, tasks: int | None = None) -> DataFrame:
    """Deal whole groups into buckets, and these to tasks; windows and grouped maps need no other shuffle."""
    number = F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int")
    return rows.withColumn(BUCKET, number).repartition(min(buckets, tasks or buckets), BUCKET)


def _by_window(rows: DataFrame, group: list[str], order: list[str], fraction: float) -> DataFrame:
    ranked = Window.partitionBy(*group).orderBy(*order)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        rows.withColumn("_rank", F.row_number().over(ranked))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn(HELD, F.col("_rank") <= held_count(F.col("_n"), fraction))
        .drop("_rank", "_n")
    )


def _by_threshold(rows: DataFrame, hot: DataFrame, code: KeyCode, order: list[str], fraction: float) -> DataFrame:
    names = code.names
    in_hot = only(rows, hot, names)
    section = F.floor(F.col(ORDER) / F.lit(float(1 << 60)) * F.col("parts"))

    def cut(counts: DataFrame, by: str, quota: str) -> DataFrame:
        """The value of ``by`` at which the running count of a group reaches its quota."""
        running = Window.partitionBy(*names).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return (
            counts.withColumn("_upto", F.sum("c").over(running))
            .filter((F.col("_upto") >= F.col(quota)) & (F.col("_upto") - F.col("c") < F.col(quota)))
            .withColumn("_take", F.col(quota) - (F.col("_upto") - F.col("c")))
        )

    quota = F.first(held_count(F.col("n"), fraction)).alias("_quota")
    by_section = in_hot.withColumn("_section", section).groupBy(*names, "_section")
    sections = cut(by_section.agg(F.count(F.lit(1)).alias("c"), quota), "_section", "_quota")
    sections = settle(sections.select(*names, "_section", "_take"), "split")
    by_hash = (
        in_hot.withColumn("_section", section)
        .join(F.broadcast(sections), [*names, "_section"])
        .groupBy(*names, ORDER)
        .agg(F.count(F.lit(1)).alias("c"), F.first("_take").alias("_quota"))
    )
    cuts = cut(by_hash, ORDER, "_quota").select(*names, F.col(ORDER).alias("_cut"), "_take", F.col("c").alias("_ties"))
    cuts = settle(cuts, "split")

    placed = only(rows, cuts, names)
    whole_ties = F.col("_take") == F.col("_ties")
    columns = [*rows.columns, HELD]
    flagged = (
        placed.filter((F.col(ORDER) != F.col("_cut")) | whole_ties)
        .withColumn(HELD, F.col(ORDER) <= F.col("_cut"))
        .select(*columns)
    )
    if cuts.filter(~whole_ties).limit(1).count() == 0:
        return flagged
    # Rows with one row key straddle the cut: count their copies, share the quota, write the copies out again.
    tied = placed.filter((F.col(ORDER) == F.col("_cut")) & ~whole_ties)
    copies = tied.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("c"), F.first("_take").alias("_take"))
    placed_copies = running_totals(copies.withColumn("_order", F.struct(*order)), names, "_order", {"_before": "c"})
    held = F.greatest(F.lit(0), F.least(F.col("c"), F.col("_take") - F.col("_before")))
    shared = placed_copies.withColumn("_in", held)
    shares = shared.select(
        *rows.columns,
        F.explode(
            F.array(
                F.struct(F.lit(True).alias(HELD), F.col("_in").alias("c")),
                F.struct(F.lit(False).alias(HELD), (F.col("c") - F.col("_in")).alias("c")),
            )
        ).alias("_share"),
    )
    return flagged.unionByName(spread_copies(shares.select(*rows.columns, "_share.*"), "c").select(*columns))


def split_rows(
    df: DataFrame,
    keys: list[str],
    target: str,
    features: list[str],
    row_key: list[str] | None = None,
    seed: int = 42,
    fraction: float = 0.2,
    fill: float | None = 0.0,
    rows_per_task: int = 1_000_000,
    bucketed: bool = False,
) -> SplitRows:
    row_key = list(row_key or df.columns)
    check_columns(df, [*keys, target, *features, *row_key])
    check_numeric(df, [target, *features])
    if not features:
        raise ValueError("no feature columns")
    code = KeyCode(df.schema, keys)
    sizes = measure(df, code, rows_per_task)
    order = [ORDER, *feature_slots(features), "y"]
    keyed = df.select(*code.coded(), *dict.fromkeys([*features, target, *row_key]))

    def observed(part: DataFrame) -> DataFrame:
        return observations(part, code.names, target, features, row_key, seed, fill)

    cold, hot, group, buckets, tasks = observed(keyed), None, code.names, 0, 0
    if sizes.hot is not None:
        # The parts are told apart by key before anything is computed from a row.
        sizes = replace(sizes, hot=settle(sizes.hot, "hot"))
        cold = observed(without(keyed, sizes.hot, code.names))
        hot_rows = observed(only(keyed, sizes.hot.select(*code.names), code.names))
        hot = _by_threshold(hot_rows, sizes.hot, code, order, fraction)
    if bucketed:
        tasks = task_count(df.sparkSession, sizes.rows, 20 * ROWS_PER_BUCKET)
        buckets = max(tasks, -(-sizes.rows // ROWS_PER_BUCKET))
        cold, group = bucket_by_key(cold, code.names, buckets, tasks), [BUCKET, *code.names]
    groups = df.select(*code.coded()).distinct()
    return SplitRows(_by_window(cold, group, order, fraction), hot, code, sizes, groups, buckets, tasks)


def holdout_split(
    df: DataFrame,
    keys: list[str],
    target: str,
    features: list[str],
    row_key: list[str] | None = None,
    seed: int = 42,
    fraction: float = 0.2,
    fill: float | None = 0.0,
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """Keys, features, target and ``is_validation``: the first ``ceil(fraction * n)`` rows by hash."""
    split = split_rows(df, keys, target, features, row_key, seed, fraction, fill, rows_per_task)
    return split.rows().select(
        *split.code.restored(),
        *[F.col(x).alias(c) for c, x in zip(features, feature_slots(features))],
        F.col("y").alias(target),
        F.col(HELD).alias("is_validation"),
    )
