"""Tumbling windows by event time with per-event lateness and a late side table.

A row is late if its time lies more than the allowed lateness behind the greatest time that arrived up
to it, whatever window it belongs to; see :mod:`driftline.operators.late_events` for how the watermark is
found in arrival order without one sorted task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.ordered import exact_sum
from driftline.functions.scalar import duration_label, truncate_to
from driftline.operators.late_events import classify

LATENESS = 30


def with_watermark(arrivals: DataFrame) -> DataFrame:
    """Arrivals (received_at, delivery_id, occurred_at, ...) with ``watermark`` including the row, and ``is_late``."""
    marked = classify(arrivals)
    return marked.withColumn("is_late", F.col("fate") != "on_time").withColumn("watermark", F.greatest("watermark", "occurred_at")).drop("fate")


def tumbling(marked: DataFrame, seconds: int) -> DataFrame:
    """On-time rows per tenant, type and window: event_count, sum_value."""
    return marked.where("NOT is_late").groupBy("tenant_id", "event_type", truncate_to("occurred_at", seconds).alias("window_start")).agg(
        F.count("*").alias("event_count"), exact_sum(F.col("value")).alias("sum_value"))


def late_bucket(marked: DataFrame, seconds: int) -> DataFrame:
    """Late rows per tenant and type; a late row belongs to no window."""
    return marked.where("is_late").groupBy("tenant_id", "event_type").agg(
        F.count("*").alias("event_count"), exact_sum(F.col("value")).alias("sum_value")).withColumn("window_duration", F.lit(duration_label(seconds)))


def first_deliveries(marked: DataFrame, seconds: int) -> DataFrame:
    """Within a window's bucket (the late bucket is one) the first delivery of each event id.

    An aggregate, so that copies collapse before the shuffle, however many there are of one id.
    """
    key = ["tenant_id", "event_type", "event_id"]
    bucket = F.when(~F.col("is_late"), truncate_to("occurred_at", seconds))
    rest = [c for c in marked.columns if c not in (*key, "received_at", "delivery_id")]
    got = marked.groupBy(*key, bucket.alias("__bucket")).agg(F.min(F.struct("received_at", "delivery_id", *rest)).alias("__r"))
    return got.select(*[F.col(c) if c in key else F.col("__r")[c].alias(c) for c in marked.columns])


def is_closed(window_start, seconds: int, watermark, lateness: int = LATENESS):
    """Closed once the watermark has reached the window's end plus the lateness."""
    return watermark >= window_start + F.make_dt_interval(secs=F.lit(seconds + lateness))


def history(marked: DataFrame, seconds: int, lateness: int = LATENESS) -> DataFrame:
    """What has been flushed: closed windows, and late buckets without a start."""
    top = marked.agg(F.max("watermark")).scalar()
    closed = tumbling(marked, seconds).where(is_closed(F.col("window_start"), seconds, top, lateness)).select(
        "tenant_id", "event_type", F.lit(duration_label(seconds)).alias("window_duration"), "window_start", "event_count", "sum_value", F.lit(False).alias("is_late"))
    late = late_bucket(marked, seconds).select(
        "tenant_id", "event_type", "window_duration", F.lit(None).cast("timestamp").alias("window_start"), "event_count", "sum_value", F.lit(True).alias("is_late"))
    return closed.unionByName(late)


def live_frames(marked: DataFrame, seconds: int) -> DataFrame:
    """The window that holds the watermark, for every tenant and type; zeros where it is empty."""
    top = marked.agg(truncate_to(F.max("watermark"), seconds)).scalar()
    keys = marked.select("tenant_id", "event_type").distinct()
    now = tumbling(marked, seconds)
    return keys.withColumn("window_start", top).join(now, ["tenant_id", "event_type", "window_start"], "left").select(
        "tenant_id", "event_type", "window_start", F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("sum_value", F.lit(0.0)).alias("sum_value"))
