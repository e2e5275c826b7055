"""Continuous scoring: new rows are joined to the models of their keys as they arrive.

Every row is scored by itself, so no state and no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from manyfold.operators.score import score
from manyfold.sources.pieces import settle_models


def score_stream(stream: DataFrame, models: DataFrame, keys: list[str], on_unknown: str = "null", **options) -> DataFrame:
    """A scored stream: a stream-static left join with a table of linear models."""
    if not stream.isStreaming:
        raise ValueError("the rows are not a stream; use score")
    return score(stream, models, keys, "linear", on_unknown, **options)


def write_scores(
    stream: DataFrame,
    models: DataFrame,
    keys: list[str],
    path: str,
    checkpoint: str,
    estimator: str = "linear",
    on_unknown: str = "null",
    once: bool = False,
    salt_hot: bool = False,
    **options,
) -> StreamingQuery:
    """Score a stream into Parquet. A linear stream is one query plan; a forest stream scores batch by batch.

    ``salt_hot`` scores a linear stream by batches too, and finds the hot keys of each to spread their rows over tasks.
    A batch overwrites its own folder, so a batch that is repeated after a failure counts once.
    """
    stored = settle_models(models, "stream-models")  # models that are not a table yet are trained once, not with every batch
    if estimator != "forest" and not salt_hot:
        scored = score_stream(stream, stored, keys, on_unknown, **options)
        writer = scored.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        def write(batch: DataFrame, number: int) -> None:
            batch.persist()  # scoring looks at the keys before it scores, and a source may be read only once
            try:
                answers = score(batch, stored, keys, estimator, on_unknown, salt_hot=salt_hot, **options)
                answers.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
            finally:
                batch.unpersist()

        writer = stream.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
