"""The append-only event log: ordered positions, streams, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalar import default_payload, limit_or, stream_name
from driftline.schemas import SCHEMAS


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["event_log"]).parquet(path)


def head(log: DataFrame) -> int:
    """Greatest position, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("stream_position"), F.lit(0))).first()[0]


def positions(rows: DataFrame, after: int, order: list[str]) -> DataFrame:
    """Gap-free positions after ``after`` in ``order``, without one sorted task.

    Rows are range-partitioned and sorted; the sizes of the partitions, one number each, place every
    partition's first position.
    """
    from driftline import scratch
    sorted_rows = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "log-order")
    sizes = {r["__p"]: r["n"] for r in sorted_rows.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    starts, at = [], after
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offsets = rows.sparkSession.createDataFrame(starts, "p int, start long")
    w = Window.partitionBy("__p").orderBy(*order)
    placed = sorted_rows.join(F.broadcast(offsets), F.col("__p") == F.col("p"))
    return placed.withColumn("stream_position", F.col("start") + F.row_number().over(w)).drop("__p", "p", "start")


def holds(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch's rows are in the log. An append commits all its files or none."""
    from driftline import scratch
    return scratch.exists(spark, path) and not read(spark, path).where(F.get_json_object("metadata", "$.batch") == batch).isEmpty()


def append(events: DataFrame, path: str, order: list[str] | None = None, batch: str | None = None) -> int:
    """Append a batch of events to the log in order; returns the new head. One writer (the driver) assigns positions."""
    spark = events.sparkSession
    try:
        at = head(read(spark, path))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        at = 0
    data = F.to_json(F.struct("tenant_id", "event_type", default_payload("payload").alias("payload"), "value", F.col("event_id").cast("string").alias("id")))
    rows = positions(events, at, order or ["occurred_at", "event_id"]).select(
        "stream_position", stream_name("tenant_id").alias("stream_name"), F.lit("EventIngested").alias("event_type"), data.alias("data"),
        (F.lit("{}") if batch is None else F.to_json(F.struct(F.lit(batch).alias("batch")))).alias("metadata"), "occurred_at")
    rows.write.mode("append").parquet(path)
    return head(read(spark, path))


def stream(log: DataFrame, name: str) -> DataFrame:
    return log.where(F.col("stream_name") == name).orderBy("stream_position")


def after(log: DataFrame, position: int, limit: int | None = None) -> DataFrame:
    """The next rows after a position, in order."""
    return log.where(F.col("stream_position") > position).orderBy("stream_position").limit(limit_or(limit, 1000, 10_000))
