"""Small files of the driver on any file system that Spark can reach."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _place(spark, path)
    return system.exists(place)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text; false if there is one already, which stays as it is.

    Of several that try at the same time one succeeds. Hadoop's local file system looks first and writes then, so a
    local path is opened by the operating system, which does both in one step.
    """
    place, system = _place(spark, path)
    if system.getUri().getScheme() == "file":
        local = place.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as out:
                out.write(text)
            return True
        except FileExistsError:
            return False
    try:
        out = system.create(place, False)
    except Py4JJavaError as problem:
        if "AlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True
