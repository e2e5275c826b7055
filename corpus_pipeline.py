"""From raw documents to a training mix, stage by stage.

Each stage takes what the one before kept, is written as Parquet below the shared folder and read again. All but the
last give the columns of ``documents``; the last adds the pass, the words taken and the training position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from manyfold.llm.decontaminate import decontaminate
from manyfold.llm.language_id import keep_known_languages
from manyfold.llm.line_dedup import without_site_lines
from manyfold.llm.mixing import training_order
from manyfold.llm.queries import vocabulary_path
from manyfold.llm.simhash_dedup import one_of_each
from manyfold.sources.settled import settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_languages(docs, vocabulary_path())


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(without_site_lines(docs))


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return training_order(docs)


STAGES = [("language", language), ("lines", lines), ("near-duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix)]

#: Learned languages and fingerprints are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
