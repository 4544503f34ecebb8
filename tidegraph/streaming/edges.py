"""Edge lists as a stream of files: the batch parser, unchanged, over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.text import parse_edges


def stream_edges(spark: SparkSession, folder: str) -> DataFrame:
    return parse_edges(spark.readStream.text(folder))
