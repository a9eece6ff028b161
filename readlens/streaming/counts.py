"""Count tables that grow with a stream: sums per key don't depend on order, so the same plan serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..table import counted


def maintain(stream: DataFrame, fields: list[str], name: str, checkpoint: str) -> StreamingQuery:
    """A running count table under an in-memory name; state and progress are kept in the checkpoint folder."""
    return counted(stream, fields).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour", at: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, by, n, value): events in tumbling windows; rows later than the watermark are dropped in a stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    return timed.groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), by, "n", "value")
