"""Deduplication of a stream of deliveries against the persistent index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lapidary.operators.messages import MessageIndex, identifier


def ingest_stream(deliveries: DataFrame, index: MessageIndex, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Feed a stream of deliveries into ``index``; a micro-batch that is repeated after a failure changes nothing."""

    def add(batch: DataFrame, _: int) -> None:
        index.ingest(batch.select(identifier().alias("id"), "received_at", "delivery_id"))

    return deliveries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
