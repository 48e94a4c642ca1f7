"""Screening of streams: the batch plan over text rows, appended, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.screen import Screen


def screened_stream(spark: SparkSession, path: str, schema, screen: Screen | None = None, text: str = "text") -> DataFrame:
    """A stream of results for the Parquet files that arrive under ``path``."""
    return (screen or Screen()).scan_texts(spark.readStream.schema(schema).parquet(path), text)


def write_stream(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Exactly once into Parquet files; processes what is there, then stops."""
    return (
        results.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
