"""Group data with a known linear law, made in place on the cluster.

The law: three uniform features, and a target that is a weighted sum of them plus normal noise, never
below zero. Every number hangs on ``(seed, key, row)`` only, so the data does not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from manyfold.functions.draws import normal, uniform
from manyfold.functions.features import key_label

# Fixed values of the law: feature ranges, weights, noise.
RANGES = {"feat_1": (10.0, 100.0), "feat_2": (5.0, 50.0), "feat_3": (1.0, 20.0)}
WEIGHTS = {"feat_1": 2.5, "feat_2": 1.8, "feat_3": 3.2}
NOISE = 20.0

PIECE = 100_000


def synth_rows(groups: DataFrame, keys: list[str], rows: int = 100, seed: int = 42) -> DataFrame:
    """``rows`` observations for every key of ``groups``, with their number as ``row_id``.

    Keys and pieces of ``PIECE`` rows are dealt to all tasks first, so a short list of keys is no bottleneck.
    """
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"), F.lit(PIECE).cast("long"))
    pieces = groups.select(*keys, F.explode(firsts).alias("_first")).repartition(tasks, *keys, "_first")
    last = F.least(F.col("_first") + F.lit(PIECE - 1), F.lit(rows - 1).cast("long"))
    numbered = pieces.select(*keys, F.explode(F.sequence(F.col("_first"), last)).alias("row_id"))
    label, row = key_label(keys), F.col("row_id")
    features = numbered.withColumns(
        {
            name: F.lit(low) + F.lit(high - low) * uniform(seed, label, row, F.lit(name))
            for name, (low, high) in RANGES.items()
        }
    )
    law = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        law = law + F.lit(weight) * F.col(name)
    noise = F.lit(NOISE) * normal(seed, label, row, F.lit("noise"))
    return features.withColumn("sales", F.greatest(F.lit(0.0), law + noise))


def synth_groups(spark: SparkSession, groups: int = 10, rows: int = 100, seed: int = 42) -> DataFrame:
    """Keys ``SKU_001``, ``SKU_002``, ... with ``rows`` observations each."""
    ids = spark.range(1, groups + 1).select(F.format_string("SKU_%03d", "id").alias("sku_id"))
    return synth_rows(ids, ["sku_id"], rows, seed)
