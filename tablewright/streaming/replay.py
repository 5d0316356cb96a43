"""Fitted transforms replayed on a stream: the same expressions and stream-static joins as on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.transforms import Step, apply


def replay(stream: DataFrame, steps: list[Step], path: str, checkpoint: str) -> StreamingQuery:
    """The stream's available rows, transformed and written as Parquet; both folders must be shared storage."""
    return apply(stream, steps).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
