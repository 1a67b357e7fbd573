"""A Structured Streaming feed into a store: every micro-batch is ingested under its own number, then rolled up and pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import RollupStore


def feed(samples: DataFrame, store: RollupStore, checkpoint: str, every: str | None = "30 seconds", name: str = "feed") -> StreamingQuery:
    """No watermark: late samples always land. A replayed batch has the number it had, and is skipped."""

    def batch(df: DataFrame, k: int) -> None:
        store.ingest(df, mark=(name, k))
        store.sweep()

    writer = samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
