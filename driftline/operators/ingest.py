"""Checking and splitting batches of events before they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalar import clamp_skew, default_payload

BATCH_ROWS, BATCH_BYTES = 500, 256 * 1024


def validate(rows: DataFrame) -> DataFrame:
    """Rows with status (201 or 400) and code; the event type is required, an empty payload becomes {}."""
    bad = F.coalesce(F.col("event_type"), F.lit("")) == ""
    return rows.withColumn("status", F.when(bad, 400).otherwise(201)).withColumn("code", F.when(bad, "EVENT_TYPE_REQUIRED")).withColumn(
        "payload", default_payload("payload"))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("status = 201").drop("status", "code"), checked.where("status <> 201")


def batch_status(checked: DataFrame) -> DataFrame:
    """(accepted, ok, status): accepted counts all rows, also failed ones; any failure makes the batch 207."""
    return checked.agg(F.count("*").alias("accepted"), F.count_if(F.col("status") == 201).alias("ok")).withColumn(
        "status", F.when(F.col("accepted") == F.col("ok"), 201).otherwise(207))


def row_results(checked: DataFrame, order: str) -> DataFrame:
    """The answer of a batch, row by row in order: index (from 0), id of what was stored, status, code, error."""
    ok, place = F.col("status") == 201, Window.orderBy(order)  # a batch has at most BATCH_ROWS rows
    return checked.select((F.row_number().over(place) - 1).alias("index"), F.when(ok, F.col("event_id").cast("string")).alias("id"), "status", "code",
                          F.when(~ok, "event_type is required").alias("error"))


def check_size(rows: int, size: int) -> None:
    if not 1 <= rows <= BATCH_ROWS:
        raise ValueError(f"a batch has 1 to {BATCH_ROWS} events")
    if size > BATCH_BYTES:
        raise ValueError(f"a batch has at most {BATCH_BYTES} bytes")


def read_lines(spark, path: str) -> DataFrame:
    """JSON lines of (event_type, payload, value, occurred_at); unreadable lines have only nulls and fail validation."""
    return spark.read.schema("event_type string, payload string, value double, occurred_at timestamp").json(path)


def with_time(rows: DataFrame, now) -> DataFrame:
    """Client times far from now are replaced by now."""
    t = F.lit(now).cast("timestamp")
    return rows.withColumn("occurred_at", F.when(F.col("occurred_at").isNull(), t).otherwise(clamp_skew("occurred_at", t)))


def dual_write(rows: DataFrame, log_path: str, events_path: str, batch: str) -> None:
    """Log first, then events, both from one batch. The batch's name makes a repetition harmless.

    Log rows carry the batch's name in their metadata, so that a batch which failed between the two writes doesn't append them again.
    """
    from driftline import scratch
    from driftline.sources import event_log
    spark = rows.sparkSession
    if scratch.exists(spark, f"{events_path}/batch={batch}/_SUCCESS"):
        return
    kept = scratch.table(rows, "ingest")
    if not event_log.holds(spark, log_path, batch):
        event_log.append(kept, log_path, batch=batch)
    kept.write.mode("overwrite").parquet(f"{events_path}/batch={batch}")
