"""Key counts over a stream of catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.harvest import explode_map


def stream_key_counts(rows: DataFrame, cell: str, order: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Running ``(key, count)`` of a streaming DataFrame, kept as the in-memory table ``name``; state is a count a key."""
    counts = explode_map(rows, cell, order).groupBy("key").agg(F.count("*").alias("count"))
    out = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()
