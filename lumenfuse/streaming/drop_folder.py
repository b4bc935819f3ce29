"""Scores of images as they arrive: a stream of image rows through the same operators, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, path: str, schema: str, metric: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Image rows from Parquet files that appear in ``path``; every micro-batch's scores go to a folder of ``sink`` named by its id.

    A batch that runs again writes its own folder again.
    """

    def batch(df: DataFrame, number: int) -> None:
        metric(df).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
