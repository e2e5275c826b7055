"""Hold-out error as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def error_metrics(actual: Column, predicted: Column) -> list[Column]:
    """``rmse``, ``mse`` and ``mae`` of the rows of one group; rows lacking either value do not count."""
    gap = actual - predicted
    mse = F.avg(gap * gap)
    return [F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(F.abs(gap)).alias("mae")]
