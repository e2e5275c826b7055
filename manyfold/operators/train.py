"""One model per group: a table of observations in, a table of models out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from manyfold.functions.features import infer_features
from manyfold.operators.linear import linear_model_columns, linear_rows
from manyfold.operators.split import split_rows
from manyfold.schema import conform, model_schema

ESTIMATORS = ("linear", "ridge", "forest")


def train(
    df: DataFrame,
    keys: list[str],
    target: str,
    features: list[str] | None = None,
    estimator: str = "forest",
    row_key: list[str] | None = None,
    min_rows: int = 10,
    fraction: float = 0.2,
    seed: int = 42,
    fill: float | None = 0.0,
    alpha: float = 1.0,
    n_estimators: int = 50,
    max_depth: int | None = None,
    min_samples_split: int = 2,
    min_samples_leaf: int = 1,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Train one model per key. A group that is too small or cannot be fitted gives a row with a status.

    ``row_key`` names columns that tell the rows of a group apart (default: all columns); the split and
    the bootstrap draws hang on it, so the result is the same for any order or partitioning of ``df``.
    ``rows_per_task`` is the group size above which a group is worked on by many tasks.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {ESTIMATORS}")
    features = list(features) if features is not None else infer_features(df, keys, target)
    schema = model_schema(df.schema, keys)
    if estimator == "forest":
        from manyfold.operators.forest import ForestSettings, train_forest

        settings = ForestSettings(n_estimators, max_depth, min_samples_split, min_samples_leaf)
        size = rows_per_task or 1_000_000
        split = split_rows(df, keys, target, features, row_key, seed, fraction, fill, size, bucketed=True)
        return train_forest(split, features, settings, min_rows, seed, schema)
    split = split_rows(df, keys, target, features, row_key, seed, fraction, fill, rows_per_task or 1_000_000)
    penalty = F.lit(float(alpha) if estimator == "ridge" else 0.0)
    fitted = linear_rows(split, features, penalty, min_rows)
    return conform(fitted.select(*split.code.restored(), *linear_model_columns(features)), schema)
