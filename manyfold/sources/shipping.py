"""The package for the Python workers of executors that were started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's Python files, once per Spark application.

    The driver serves the file to every executor, so it may lie in a folder of the driver's own.
    """
    context = spark.sparkContext
    if getattr(context, "_manyfold_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="manyfold-package-"), "manyfold_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._manyfold_shipped = True
