"""The session roll-up as a stream: event time, a watermark for late hits, and state in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(hits: DataFrame, idle: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of ``hits`` (user_id, ts timestamp, bytes), closed once the watermark passes their end.

    ``session_window`` joins hits whose distance is at most the idle time, as the batch operator does.
    """
    return (
        hits.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", idle).alias("span"))
        .agg(F.count(F.lit(1)).alias("hits"), F.sum("bytes").alias("bytes"), F.min("ts").alias("opened"), F.max("ts").alias("updated"))
        .drop("span")
    )


def deliver(frame: DataFrame, deliver_batch, checkpoint: str, **trigger):
    """Hand each micro-batch to ``deliver_batch(frame, number)``; numbers repeat after a failure, so it can skip what is done."""
    return frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(deliver_batch).trigger(**(trigger or {"availableNow": True})).start()
