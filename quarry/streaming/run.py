"""The operators on streams: each maps rows to rows without state, so a plan for tables runs on a stream as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def transform_stream(spark: SparkSession, source: str, target: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame], max_files: int = 1000) -> StreamingQuery:
    """Parquet files that arrive in ``source`` go through ``plan`` to ``target``; restarts go on from ``checkpoint``. Takes what is there and ends."""
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return plan(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
