"""Feature lists, checks against a schema, and the one rule for missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def infer_features(df: DataFrame, keys: list[str], target: str, exclude: list[str] = ()) -> list[str]:
    """Every column but the target and the keys (and whatever else is excluded by name)."""
    out = {target, *keys, *exclude}
    return [c for c in df.columns if c not in out]


def check_columns(df: DataFrame, columns: list[str]) -> None:
    """Raise before any job starts when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")


def filled(column: Column, fill: float | None = 0.0) -> Column:
    """The feature as a double, null and NaN replaced; ``fill=None`` keeps a missing value as null."""
    x = column.cast("double")
    if fill is None:
        return F.when(~F.isnan(x), x)
    return F.coalesce(F.nanvl(x, F.lit(float(fill))), F.lit(float(fill)))


def prepare_features(df: DataFrame, features: list[str], fill: float | None = 0.0) -> DataFrame:
    """Fill the features in place. Training and scoring both go through this rule."""
    check_columns(df, features)
    return df.withColumns({c: filled(F.col(c), fill) for c in features})


def key_label(keys: list) -> Column:
    """The key, given by names or as columns, as text, for messages and for draws."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("None")) for c in columns])


def check_numeric(df: DataFrame, columns: list[str]) -> None:
    bad = [c for c in columns if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    if bad:
        raise ValueError(f"column(s) {bad} are not numeric")
