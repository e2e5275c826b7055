"""Result schemas: one row per key, fixed types, every column nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

SUCCESS = "success"
TOO_SMALL = "insufficient_data"
ERROR = "error: "

HYPERPARAMETERS = ["n_estimators", "max_depth", "min_samples_split", "min_samples_leaf"]

_MODEL_FIELDS = [
    T.StructField("model_bytes", T.BinaryType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("rmse", T.DoubleType()),
    T.StructField("mse", T.DoubleType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("num_rows", T.LongType()),
]
_STATUS = T.StructField("status", T.StringType())


def key_fields(schema: T.StructType, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, schema[k].dataType) for k in keys]


def model_schema(schema: T.StructType, keys: list[str]) -> T.StructType:
    """Model rows of a plain training over a table of this schema; the keys stay typed."""
    return T.StructType(key_fields(schema, keys) + _MODEL_FIELDS + [_STATUS])


def tuned_schema(schema: T.StructType, keys: list[str], params: dict[str, T.DataType] | None = None) -> T.StructType:
    """Model rows of a tuned training: the chosen hyperparameters stand before the status."""
    if params is None:
        params = {name: T.LongType() for name in HYPERPARAMETERS}
    chosen = [T.StructField(name, kind) for name, kind in params.items()]
    return T.StructType(key_fields(schema, keys) + _MODEL_FIELDS + chosen + [_STATUS])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring the columns into the order and the types of ``schema``, so stored tables never drift."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
