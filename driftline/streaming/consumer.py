"""At-least-once consumption with retries and dead letters, exactly-once in effect by idempotent sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions.codec import decode_events
from driftline.sources import topic as topics

ATTEMPTS, BASE_S, CAP_S = 3, 0.1, 5.0


def handle(batch: DataFrame, batch_id: int, handler: Callable[[DataFrame, int], DataFrame | None], topic: str, dlq: str | None, attempts: int = ATTEMPTS,
           base_s: float = BASE_S, cap_s: float = CAP_S) -> None:
    """Decode, hand over, retry; what fails goes to the dead letters, under the batch's id.

    A handler that returns rows (event_id, last_error) says which events failed: only these are handed over again, under the id
    ``<batch>.<attempt>``, and only they become dead letters. One that raises has failed for all it was given.
    Undecodable messages go there at once. Without a dead-letter place they are dropped; if it can't be
    written, the batch fails and is delivered again.
    """
    batch = batch.persist()
    try:
        good, bad = topics.decoded(batch)
        if dlq:
            topics.dead_letters(bad, topic, "unmarshal_failed", 1).write.mode("overwrite").parquet(f"{dlq}/unmarshal/batch={batch_id}")
        pending, failed, error = good, None, None
        for n in range(1, attempts + 1):
            try:
                failed, error = handler(pending, batch_id if n == 1 else f"{batch_id}.{n}"), None
                if failed is not None:
                    failed = scratch.table(failed.groupBy("event_id").agg(F.max("last_error").alias("last_error")), "failed-events")
                if failed is None or failed.isEmpty():
                    return
                pending = good.join(failed.select("event_id"), "event_id", "left_semi")
            except Exception as e:  # noqa: BLE001  (whatever the handler raises counts as a failure)
                error = str(e)[:500]
            if n < attempts:
                time.sleep(min(cap_s, base_s * 2 ** (n - 1)))
        if dlq:
            rows = batch.withColumn("__id", decode_events("value")["id"])
            if failed is not None:  # all that is still pending
                rows = rows.join(failed.select(F.col("event_id").alias("__id"), "last_error"), "__id")
            if failed is None or error:
                rows = rows.withColumn("last_error", F.lit(error))
            topics.dead_letters(rows, topic, "handler_failed_after_retries", attempts).write.mode("overwrite").parquet(f"{dlq}/failed/batch={batch_id}")
    finally:
        batch.unpersist()


def consume(spark: SparkSession, topic: str, handler: Callable[[DataFrame, int], DataFrame | None], checkpoint: str, dlq: str | None = None,
            files_per_trigger: int = 100, once: bool = True):
    """Run ``handler(events, batch_id)`` over the topic; all that is there with ``once``, else on and on."""
    stream = topics.subscribe(spark, topic, files_per_trigger)
    writer = stream.writeStream.foreachBatch(lambda b, i: handle(b, i, handler, topic, dlq)).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="1 second").start()
    if once:
        query.awaitTermination()
    return query
