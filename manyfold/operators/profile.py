"""Looking at the input and at the outcome of a training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from manyfold.functions.draws import order_hash
from manyfold.functions.features import check_columns
from manyfold.schema import HYPERPARAMETERS, SUCCESS


def profile_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, groups, and the smallest, middle and largest group."""
    check_columns(df, keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
        F.count(F.lit(1)).alias("num_groups"),
        F.min("n").alias("min_rows"),
        F.median("n").alias("median_rows"),
        F.max("n").alias("max_rows"),
    )


def group_size_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups have each size."""
    check_columns(df, keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    return sizes.groupBy("group_rows").agg(F.count(F.lit(1)).alias("num_groups"))


def preview(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def input_example(df: DataFrame, target: str, row_key: list[str], n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by hash, without the target; only the n best of each task travel."""
    check_columns(df, [target, *row_key])
    hashed = df.withColumn("_h", order_hash(seed, *[F.col(c) for c in row_key]))
    return hashed.orderBy("_h", *row_key).limit(n).drop("_h", target)


def successful(models: DataFrame) -> DataFrame:
    """The filter reaches the Parquet scan of a stored model table."""
    return models.filter(F.col("status") == SUCCESS)


def model_size() -> Column:
    return F.length("model_bytes").cast("long")


def review_models(models: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics, size and status per key. A stored table has the size as a column, so no model is read."""
    size = F.col("model_size_bytes") if "model_size_bytes" in models.columns else model_size()
    chosen = [c for c in HYPERPARAMETERS if c in models.columns]
    return models.select(*keys, "rmse", "mse", "mae", "num_rows", size.alias("model_size_bytes"), *chosen, "status")


def status_summary(models: DataFrame) -> DataFrame:
    """Models and rows per kind of outcome; the message of an error is left off."""
    kind = F.element_at(F.split("status", ": ", 2), 1)
    return models.groupBy(kind.alias("outcome")).agg(
        F.count(F.lit(1)).alias("num_models"), F.sum("num_rows").alias("num_rows")
    )


def run_metrics(models: DataFrame, trials_per_key: int | None = None) -> DataFrame:
    """Unweighted averages over the successful models, with the number of models and of failures."""
    good = F.col("status") == SUCCESS
    extra = [] if trials_per_key is None else [F.lit(float(trials_per_key)).alias("trials_per_key")]
    return models.agg(
        *[F.avg(F.when(good, F.col(m))).alias(f"avg_{m}") for m in ("rmse", "mse", "mae")],
        F.count(F.when(good, F.lit(1))).cast("double").alias("num_keys"),
        F.count(F.when(~good, F.lit(1))).cast("double").alias("num_failed"),
        *extra,
    )
