"""Read models kept up to date by streaming the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.projections import Projection
from driftline.schemas import SCHEMAS


def follow(spark: SparkSession, log_path: str, projection: Projection, root: str, files_per_trigger: int = 100, once: bool = True):
    """One query per projection. A batch moves the projection to the batch's head; one already applied does nothing.

    The batch itself is applied, if it goes on where the projection stands. The position is the guard: state and position are one
    folder, so a repeated batch finds its rows below it.
    """
    stream = spark.readStream.schema(SCHEMAS["event_log"]).option("maxFilesPerTrigger", files_per_trigger).parquet(log_path)

    def each(batch: DataFrame, batch_id: int) -> None:
        at = projection.position(spark, root)
        new = batch.where(F.col("stream_position") > at).agg(F.max("stream_position").alias("head"), F.count_distinct("stream_position").alias("n")).first()
        if new.head is not None:
            # A batch of some files of an append may have gaps; then the log is read, from the position on.
            whole = new.n == new.head - at
            projection.catch_up(batch if whole else spark.read.schema(SCHEMAS["event_log"]).parquet(log_path), root, head=new.head)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/{projection.name}-checkpoint")
    query = writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="1 second").start()
    if once:
        query.awaitTermination()
    return query
