"""Runs and versions, kept as small files that Spark reads as tables.

A run records one training: where its bundle and metrics file are, its averaged metrics, a few example
rows. A version gives a run a number under a model name. Every record is a file of its own, made in one step that
fails if the file is there: whoever makes the file of a number has that number, and the others take the next.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from manyfold.operators.profile import run_metrics
from manyfold.operators.score import score
from manyfold.sources.files import create_once, exists
from manyfold.sources.tables import Namespace, load_bundle

RUNS = "runs"
VERSIONS = "versions"

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("estimator", T.StringType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("fill", T.DoubleType()),
        T.StructField("bundle_path", T.StringType()),
        T.StructField("metrics_path", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("input_example", T.ArrayType(T.StringType())),
    ]
)
VERSION_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("run_id", T.StringType()),
    ]
)


# A run's example is a few rows to look at. A larger frame is refused, not cut.
EXAMPLE_ROWS = 100


def _record(spark: SparkSession, namespace: Namespace, kind: str, name: str, schema: T.StructType, values: tuple) -> bool:
    """Writes one record, unless there is one of this name."""
    return create_once(spark, f"{namespace.registry(kind)}/{name}.json", json.dumps(dict(zip(schema.names, values))))


def log_run(
    namespace: Namespace,
    run_name: str,
    models: DataFrame,
    keys: list[str],
    estimator: str,
    bundle_path: str,
    metrics_path: str,
    example: DataFrame | None = None,
    trials_per_key: int | None = None,
    fill: float | None = 0.0,
) -> str:
    """Record a training as one run and return its id. Only the averages and the example rows are collected."""
    spark = models.sparkSession
    averages = {k: v for k, v in run_metrics(models, trials_per_key).first().asDict().items() if v is not None}
    rows = [] if example is None else [r.j for r in example.limit(EXAMPLE_ROWS + 1).select(F.to_json(F.struct("*")).alias("j")).collect()]
    if len(rows) > EXAMPLE_ROWS:
        raise ValueError(f"an example has at most {EXAMPLE_ROWS} rows; pass a smaller frame")
    run_id = uuid.uuid4().hex
    entry = (run_id, run_name, estimator, list(keys), fill, bundle_path, metrics_path, averages, rows)
    _record(spark, namespace, RUNS, run_id, RUN_SCHEMA, entry)
    return run_id


def _table(spark: SparkSession, namespace: Namespace, kind: str, schema: T.StructType) -> DataFrame:
    folder = namespace.registry(kind)
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folder)


def runs(spark: SparkSession, namespace: Namespace) -> DataFrame:
    return _table(spark, namespace, RUNS, RUN_SCHEMA)


def versions(spark: SparkSession, namespace: Namespace) -> DataFrame:
    return _table(spark, namespace, VERSIONS, VERSION_SCHEMA)


def find_run(spark: SparkSession, namespace: Namespace, run_id: str) -> Row:
    found = runs(spark, namespace).filter(F.col("run_id") == run_id).first()
    if found is None:
        raise KeyError(f"no run {run_id}")
    return found


def register(spark: SparkSession, namespace: Namespace, name: str, run_id: str) -> int:
    """Give the run the next free version number of this model name, whoever else registers at the same time."""
    find_run(spark, namespace, run_id)
    last = versions(spark, namespace).filter(F.col("name") == name).agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    while not _record(spark, namespace, VERSIONS, f"{quote(name, safe='')}/{version}", VERSION_SCHEMA, (name, version, run_id)):
        version += 1
    return version


def latest_versions(spark: SparkSession, namespace: Namespace) -> DataFrame:
    """The newest version of every model name."""
    table = versions(spark, namespace)
    return table.groupBy("name").agg(F.max("version").alias("version"), F.max_by("run_id", "version").alias("run_id"))


@dataclass(frozen=True)
class LoadedModels:
    """One version: its models, and what scoring needs to know about their training."""

    name: str
    version: int
    run_id: str
    models: DataFrame
    keys: list[str]
    estimator: str
    fill: float | None

    def score(self, rows: DataFrame, **options) -> DataFrame:
        return score(rows, self.models, self.keys, self.estimator, fill=self.fill, **options)


def load_version(spark: SparkSession, namespace: Namespace, name: str, version: int | None = None) -> LoadedModels:
    """A named model by version, by default the newest."""
    mine = versions(spark, namespace).filter(F.col("name") == name)
    if version is not None:
        mine = mine.filter(F.col("version") == version)
    chosen = mine.orderBy(F.desc("version")).first()
    if chosen is None:
        raise KeyError(f"no version {version or ''} of {name}")
    run = find_run(spark, namespace, chosen.run_id)
    models = load_bundle(spark, run.bundle_path)
    return LoadedModels(name, chosen.version, run.run_id, models, list(run["keys"]), run.estimator, run.fill)
