"""Least squares and ridge per group, from centred sums.

One aggregate per group carries everything a fit needs, so no group is ever held in memory and a hot
key collapses in the map-side half of the aggregate. Only the small systems leave the JVM: a vectorised
function solves a whole batch of them at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from manyfold.functions.metrics import error_metrics
from manyfold.operators.split import HELD, SplitRows
from manyfold.operators.wide_moments import streamed_moments
from manyfold.schema import ERROR, SUCCESS, TOO_SMALL

# A feature counts as constant, and a system as singular, below this share of its scale.
TOLERANCE = 1e-12

# Above this, one aggregate expression per pair of features is slower than streaming the rows.
MANY_FEATURES = 12

# The text form of a linear model inside model_bytes; Catalyst writes and reads it without Python.
MODEL_JSON = "struct<intercept:double,coefficients:array<double>>"


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def moments(rows: Column, p: int, tag: str) -> list[Column]:
    """Means and centred second moments over the rows where the condition holds."""
    x = [F.when(rows, F.col(f"x{i}")) for i in range(p)]
    y = F.when(rows, F.col("y"))
    upper = [F.covar_pop(x[i], x[j]) for i, j in pairs(p)]
    return [
        F.count(F.when(rows, F.lit(1))).alias(f"{tag}_n"),
        F.array(*[F.avg(c) for c in x]).alias(f"{tag}_mean"),
        F.avg(y).alias(f"{tag}_ymean"),
        F.array(*upper).alias(f"{tag}_cxx"),
        F.array(*[F.covar_pop(c, y) for c in x]).alias(f"{tag}_cxy"),
        F.var_pop(y).alias(f"{tag}_cyy"),
    ]


def data_faults(p: int) -> list[Column]:
    """Counts of rows no fit can use; the status of a group is decided from them."""
    lost = F.col("y").isNull() | F.isnan("y")
    endless = F.lit(False)
    for c in ["y", *[f"x{i}" for i in range(p)]]:
        endless = endless | F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False))
    unfilled = F.lit(False)
    for i in range(p):
        unfilled = unfilled | F.col(f"x{i}").isNull()
    return [
        F.count(F.lit(1)).alias("num_rows"),
        F.count(F.when(lost, F.lit(1))).alias("lost_targets"),
        F.count(F.when(unfilled, F.lit(1))).alias("lost_features"),
        F.count(F.when(endless, F.lit(1))).alias("endless_values"),
    ]


def fault_status(min_rows: int) -> Column:
    """Null when the group can be fitted."""
    return (
        F.when(F.col("num_rows") < min_rows, F.lit(TOO_SMALL))
        .when(F.col("lost_targets") > 0, F.lit(ERROR + "missing target"))
        .when(F.col("lost_features") > 0, F.lit(ERROR + "missing feature"))
        .when(F.col("endless_values") > 0, F.lit(ERROR + "value is not finite"))
    )


def solve_batch(n: np.ndarray, cxx: np.ndarray, cxy: np.ndarray, mean: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Coefficients of a batch of systems; a singular one gives a row of NaN and harms no other."""
    m, p = cxy.shape
    full = np.zeros((m, p, p))
    for k, (i, j) in enumerate(pairs(p)):
        full[:, i, j] = full[:, j, i] = cxx[:, k]
    diagonal = np.einsum("mii->mi", full)
    free = alpha[:, None] == 0
    usable = ~np.any(free & (diagonal <= TOLERANCE * mean**2), axis=1) & np.all(np.isfinite(full), axis=(1, 2))
    ridged = full + (alpha / np.maximum(n, 1))[:, None, None] * np.eye(p)
    ridged[~usable] = np.eye(p)
    scale = np.sqrt(np.einsum("mii->mi", ridged))
    correlation = ridged / (scale[:, :, None] * scale[:, None, :])
    usable &= (np.linalg.eigvalsh(correlation)[:, 0] > TOLERANCE) | (alpha > 0)
    correlation[~usable] = np.eye(p)
    w = np.linalg.solve(correlation, (cxy / scale)[:, :, None])[:, :, 0] / scale
    w[~usable] = np.nan
    return w


def _stack(column: pd.Series, width: int) -> np.ndarray:
    if len(column) == 0:
        return np.zeros((0, width))
    return np.array([np.full(width, np.nan) if v is None else np.asarray(v, dtype=float) for v in column])


@pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(n: pd.Series, cxx: pd.Series, cxy: pd.Series, mean: pd.Series, alpha: pd.Series) -> pd.Series:
    p = len(cxy.iloc[0]) if len(cxy) else 0
    w = solve_batch(
        n.to_numpy(float), _stack(cxx, p * (p + 1) // 2), _stack(cxy, p), _stack(mean, p), alpha.to_numpy(float)
    )
    return pd.Series([None if np.isnan(row).any() else row for row in w])


@pandas_udf(T.DoubleType())
def held_error_batch(
    coef: pd.Series, intercept: pd.Series, mean: pd.Series, ymean: pd.Series, cxx: pd.Series, cxy: pd.Series, cyy: pd.Series
) -> pd.Series:
    """The mean squared error of each fit on rows known by their centred sums."""

    def one(w, b, m, my, full, cross, var):
        if w is None:
            return np.nan
        i, j = np.triu_indices(len(w))
        bend = (np.where(i == j, 1.0, 2.0) * w[i] * w[j] * full).sum()
        return max(0.0, var - 2.0 * w @ cross + bend + (my - b - w @ m) ** 2)

    return pd.Series([one(*row) for row in zip(coef, intercept, mean, ymean, cxx, cxy, cyy)], dtype=float)


def coefficients(p: int, alpha: Column) -> Column:
    """The fitted slopes as an array, null for a singular system."""
    if p > 1:
        return _solve("fit_n", "fit_cxx", "fit_cxy", "fit_mean", alpha.cast("double"))
    spread, centre = F.col("fit_cxx")[0], F.col("fit_mean")[0]
    varies = (alpha > 0) | (spread > TOLERANCE * centre * centre)
    return F.when(varies, F.array(F.col("fit_cxy")[0] / (spread + alpha / F.col("fit_n"))))


def dot(coefs: Column, p: int, value) -> Column:
    total = F.lit(0.0)
    for i in range(p):
        total = total + coefs[i] * value(i)
    return total


def with_intercept(stats: DataFrame, p: int) -> DataFrame:
    slopes = F.col("coef")
    return stats.withColumn("intercept", F.col("fit_ymean") - dot(slopes, p, lambda i: F.col("fit_mean")[i]))


def group_moments(rows: DataFrame, names: list[str], p: int, hot: bool, held_too: bool = False) -> DataFrame:
    if p > MANY_FEATURES:
        faults = rows.groupBy(*names).agg(*data_faults(p))
        return faults.join(streamed_moments(rows, names, p, hot), names)
    held = moments(F.col(HELD), p, "held") if held_too else []
    return rows.groupBy(*names).agg(*data_faults(p), *moments(~F.col(HELD), p, "fit"), *held)


def fit_metrics(rows: DataFrame, fits: DataFrame, names: list[str], p: int, hot: bool) -> DataFrame:
    """Model rows with their hold-out error. Every group has a validation row, so no key is lost.

    Cold rows are already partitioned and sorted by key, so a merge join moves only the fits; the fits of
    hot keys are few enough to be broadcast.
    """
    carried = [c for c in fits.columns if c not in names]
    held = rows.filter(HELD).select(*names, *[f"x{i}" for i in range(p)], "y")
    joined = held.join(fits.hint("broadcast" if hot else "merge"), names)
    predicted = F.col("intercept") + dot(F.col("coef"), p, lambda i: F.col(f"x{i}"))
    measured = [m for m in error_metrics(F.col("y"), predicted)]
    return joined.groupBy(*names).agg(*measured, *[F.first(c).alias(c) for c in carried])


def linear_rows(split: SplitRows, features: list[str], alpha: Column, min_rows: int) -> DataFrame:
    """Fit every group and measure it on its validation rows; coded keys, not yet a model table."""
    p = len(features)
    names = split.code.names
    result = None
    for rows, hot in split.parts():
        stats = group_moments(rows, names, p, hot).withColumn("fault", fault_status(min_rows))
        part = fit_from_moments(stats, p, alpha, names)
        part = fit_metrics(rows, part, names, p, hot)
        result = part if result is None else result.unionByName(part)
    return result


def fit_from_moments(stats: DataFrame, p: int, alpha: Column, names: list[str]) -> DataFrame:
    solved = with_intercept(stats.withColumn("coef", coefficients(p, alpha)), p)
    usable = F.col("fault").isNull()
    return solved.select(
        *names,
        "num_rows",
        "fault",
        F.when(usable, F.col("coef")).alias("coef"),
        F.when(usable, F.col("intercept")).alias("intercept"),
    )


def linear_model_columns(features: list[str]) -> list[Column]:
    """The model columns of :data:`manyfold.schema.model_schema` from fitted rows."""
    status = F.coalesce(
        F.col("fault"), F.when(F.col("intercept").isNull(), F.lit(ERROR + "singular matrix")), F.lit(SUCCESS)
    )
    good = status == SUCCESS
    body = F.to_json(F.struct(F.col("intercept"), F.col("coef").alias("coefficients")))
    names = F.array(*[F.lit(c) for c in features])
    return [
        F.when(good, F.encode(body, "UTF-8")).alias("model_bytes"),
        F.when(good, names).alias("feature_names"),
        *[F.when(good, F.col(m)).alias(m) for m in ("rmse", "mse", "mae")],
        F.col("num_rows"),
        status.alias("status"),
    ]
