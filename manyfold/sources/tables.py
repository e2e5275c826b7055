"""Feature tables in, model tables, bundles and metric files out. Nothing passes through the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from manyfold.functions.features import check_columns
from manyfold.functions.keys import null_safe
from manyfold.operators.profile import model_size, successful
from manyfold.schema import HYPERPARAMETERS, SUCCESS
from manyfold.sources.files import exists
from manyfold.sources.pieces import PIECE, Pieced, pieces_of, with_pieces


@dataclass(frozen=True)
class Namespace:
    """A database for tables and a folder beside it for artifacts."""

    name: str
    folder: str

    def table(self, name: str) -> str:
        return f"{self.name}.{name}"

    def registry(self, kind: str) -> str:
        return f"{self.folder.rstrip('/')}/registry/{kind}"

    def artifact(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/artifacts/{name}"


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def init_namespace(spark: SparkSession, name: str, folder: str) -> Namespace:
    """Create the database, unless it is there, with its tables below ``folder``, and make it current."""
    place = f"{folder.rstrip('/')}/tables"
    spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:name) LOCATION " + quoted(place), args={"name": f"`{name.replace('`', '``')}`"})
    spark.catalog.setCurrentDatabase(name)
    return Namespace(name, folder)


def read_features(spark: SparkSession, source: str, columns: list[str] | None = None) -> DataFrame:
    """A catalog table, or a Parquet path when the name has a slash; only the named columns are read."""
    df = spark.read.parquet(source) if "/" in source else spark.read.table(source)
    if columns is None:
        return df
    check_columns(df, columns)
    return df.select(*columns)


def write_models(models: DataFrame, table: str, keys: list[str] | None = None, buckets: int = 0) -> None:
    """Replace a model table; its schema may change. The size of each model is stored beside it.

    With ``buckets`` the table is bucketed and sorted by key, so a join on the key needs no shuffle of it.
    """
    writer = models.withColumn("model_size_bytes", model_size()).write.mode("overwrite").format("parquet")
    if buckets:
        if not keys:
            raise ValueError("bucketing a model table needs its keys")
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(table)


def read_models(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.table(table)


#: The folder of a bundle for models in pieces; Spark passes over it when it reads the bundle itself.
PIECES = "_pieces"


def bundle(models: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The successful models of one training as a table of their own, clustered by key.

    Models that are in pieces stay so, in a folder beside the rows of their keys, which have no cell then.
    """
    columns, parts = [*keys, "model_bytes", "feature_names"], pieces_of(models)
    if parts is not None and parts.keys != list(keys):
        parts = None
    whole = models if parts is None else parts.cells
    kept = successful(whole).select(*columns, model_size().alias("model_size_bytes"))
    kept.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    spark = models.sparkSession
    if parts is not None:
        parts.pieces.withColumn("piece_bytes", model_size()).write.parquet(_pieces(path))
        # A piece has a header as the model has one, of 12 bytes.
        size = (F.lit(12) + F.sum(F.col("piece_bytes") - 12)).alias("model_size_bytes")
        sizes = spark.read.parquet(_pieces(path)).groupBy(*keys).agg(size)
        slim = successful(parts.slim).select(*columns)
        sized = slim.join(F.broadcast(sizes), null_safe(slim, sizes, keys))
        sized.select(*[slim[c] for c in columns], "model_size_bytes").write.mode("append").parquet(path)
    found = load_bundle(spark, path)
    return with_pieces(found.drop("status"), pieces_of(found))


def _pieces(path: str) -> str:
    return f"{path.rstrip('/')}/{PIECES}"


def bundle_stats(bundled: DataFrame) -> DataFrame:
    """Number of models and their size. The size column answers it; no model is read."""
    size, parts = F.coalesce(F.sum("model_size_bytes"), F.lit(0)), pieces_of(bundled)
    bundled = bundled if parts is None else parts.rest()
    return bundled.agg(
        F.count(F.lit(1)).alias("num_models"),
        size.alias("size_bytes"),
        F.round(size / F.lit(1024.0 * 1024.0), 2).alias("size_mb"),
    )


def load_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A bundle in the shape of a model table; models are decoded where their rows are scored."""
    rows = spark.read.parquet(path).withColumn("status", F.lit(SUCCESS))
    if not exists(spark, _pieces(path)):
        return rows
    pieces = spark.read.parquet(_pieces(path)).drop("piece_bytes")
    keys = [c for c in pieces.columns if c not in (PIECE, "model_bytes")]
    cell = F.col("model_bytes").isNotNull()
    return Pieced(rows.filter(cell), rows.filter(~cell), pieces, keys).models()


def metrics_table(models: DataFrame, keys: list[str]) -> DataFrame:
    chosen = [c for c in [*HYPERPARAMETERS, "alpha"] if c in models.columns]
    return successful(models).select(*keys, "rmse", "mse", "mae", "num_rows", *chosen)


def write_metrics(models: DataFrame, keys: list[str], path: str) -> None:
    """Metrics of the successful models as CSV with a header."""
    metrics_table(models, keys).write.mode("overwrite").csv(path, header=True)
