"""Intermediate tables that survive a lost executor.

``settle`` writes a frame as Parquet below the shared folder named by ``spark.checkpoint.dir`` and
reads it back: the lineage is cut, and Catalyst knows the true size when it next chooses a join.
What was shuffled for the table is not needed once it is written, so Spark drops these files then, not when the driver
next collects its garbage; the disk holds the tables and the shuffles of one step.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: an execution drops its shuffle files when it ends. A frame that is run again shuffles again.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="manyfold-"))
    return context.getCheckpointDir()


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
