"""The whole course of a training: fit or tune, store, bundle, record, register."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from manyfold.operators.profile import input_example
from manyfold.operators.train import train
from manyfold.operators.tune import tune
from manyfold.sources.registry import LoadedModels, load_version, log_run, register
from manyfold.sources.tables import Namespace, bundle, read_models, write_metrics, write_models


def publish(
    namespace: Namespace,
    name: str,
    models: DataFrame,
    keys: list[str],
    estimator: str,
    example: DataFrame | None = None,
    trials_per_key: int | None = None,
    fill: float | None = 0.0,
) -> LoadedModels:
    """Store the models, bundle the successful ones, record one run and register a version of it."""
    spark = models.sparkSession
    table = namespace.table(name)
    write_models(models, table)
    stored = read_models(spark, table)
    stamp = uuid4().hex
    bundle_path, metrics_path = namespace.artifact(f"{name}/{stamp}/bundle"), namespace.artifact(f"{name}/{stamp}/metrics")
    bundle(stored, keys, bundle_path)
    write_metrics(stored, keys, metrics_path)
    run_id = log_run(
        namespace, f"{name}_published", stored, keys, estimator, bundle_path, metrics_path, example, trials_per_key, fill
    )
    return load_version(spark, namespace, name, register(spark, namespace, name, run_id))


def train_and_publish(
    namespace: Namespace, name: str, df: DataFrame, keys: list[str], target: str, row_key: list[str], **settings
) -> LoadedModels:
    models = train(df, keys, target, row_key=row_key, **settings)
    example = input_example(df, target, row_key)
    estimator, fill = settings.get("estimator", "forest"), settings.get("fill", 0.0)
    return publish(namespace, name, models, keys, estimator, example, fill=fill)


def tune_and_publish(
    namespace: Namespace,
    name: str,
    df: DataFrame,
    keys: list[str],
    target: str,
    row_key: list[str],
    num_trials: int = 10,
    **settings,
) -> LoadedModels:
    models = tune(df, keys, target, num_trials=num_trials, row_key=row_key, **settings)
    example = input_example(df, target, row_key)
    estimator, fill = settings.get("estimator", "forest"), settings.get("fill", 0.0)
    return publish(namespace, name, models, keys, estimator, example, num_trials, fill)
