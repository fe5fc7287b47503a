"""The nightly rollup: aggregate, write, read, validate."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.codec import float_text
from driftline.functions.ordered import exact_sum
from driftline.operators.final import final_events, final_rollup


def daily(events: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """(tenant_id, event_type, date, event_count, total_value) of all days, or of [first, last) as one job."""
    if first is not None:
        events = events.where(F.col("occurred_at") >= F.lit(dt.datetime.combine(first, dt.time())))
    if last is not None:
        events = events.where(F.col("occurred_at") < F.lit(dt.datetime.combine(last, dt.time())))
    return events.groupBy("tenant_id", "event_type", F.to_date("occurred_at").alias("date")).agg(
        F.count("*").alias("event_count"), exact_sum(F.col("value")).alias("total_value"))


def run(events: DataFrame, path: str, first: dt.date, last: dt.date, inserted_at: dt.datetime) -> None:
    """Append the rollup of [first, last), stamped; a rerun adds rows that win. An empty day writes nothing."""
    daily(events, first, last).withColumn("inserted_at", F.lit(inserted_at)).write.mode("append").partitionBy("date").parquet(path)


def repair(events: DataFrame, path: str, day: dt.date, inserted_at: dt.datetime) -> None:
    """Replace a day's partition, also by nothing when its events are gone."""
    from driftline import scratch
    scratch.remove(events.sparkSession, f"{path}/date={day.isoformat()}")
    run(events, path, day, day + dt.timedelta(days=1), inserted_at)


def olap_range(first: str | None, last: str | None, today: dt.date, most_days: int = 366) -> tuple[dt.date, dt.date]:
    """Defaults and limits of a daily-stats request: the 30 days to tomorrow; first before last; at most 366 days."""
    end = dt.date.fromisoformat(last) if last else today + dt.timedelta(days=1)
    start = dt.date.fromisoformat(first) if first else end - dt.timedelta(days=30)
    if not start < end:
        raise ValueError("the range is empty")
    if (end - start).days > most_days:
        raise ValueError(f"a range has at most {most_days} days")
    return start, end


def tenant_days(events: DataFrame, tenant: str, first: dt.date, last: dt.date, dedup: bool = True, limit: int | None = None) -> DataFrame:
    """A tenant's (date, event_type, event_count, total_value), newest day and largest count first.

    The filter is on key columns of the deduplication, so it runs before it and reaches the scan.
    """
    got = events.where((F.col("tenant_id") == tenant) & (F.col("occurred_at") >= F.lit(dt.datetime.combine(first, dt.time())))
                       & (F.col("occurred_at") < F.lit(dt.datetime.combine(last, dt.time()))))
    if dedup:
        got = final_events(got)
    got = got.groupBy(F.to_date("occurred_at").alias("date"), "event_type").agg(
        F.count("*").alias("event_count"), exact_sum(F.col("value")).alias("total_value"))
    if limit is None:
        return got
    return got.orderBy(F.desc("date"), F.desc("event_count"), "event_type").limit(limit if 1 <= limit <= 10_000 else 5_000)


def _tenant_texts(rollup: DataFrame) -> DataFrame:
    """(tenant_id, text): a tenant's rows as lines in key order, without inserted_at."""
    line = F.concat(F.concat_ws("|", "tenant_id", "event_type", F.date_format("date", "yyyy-MM-dd"), F.col("event_count").cast("string"),
                                float_text("total_value")), F.lit("\n"))
    per_tenant = rollup.select("tenant_id", "event_type", "date", line.alias("line")).groupBy("tenant_id").agg(
        F.array_sort(F.collect_list(F.struct("event_type", "date", "line"))).alias("rows"))
    return per_tenant.select("tenant_id", F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("text"))


def checksums(rollup: DataFrame) -> DataFrame:
    """(tenant_id, checksum): SHA-256 over each tenant's rows in key order, hashed in Spark; nothing reaches the driver.

    A tenant's rows are bounded by its event types and days.
    """
    return _tenant_texts(rollup).select("tenant_id", F.sha2("text", 256).alias("checksum"))


def checksum(rollup: DataFrame) -> str:
    """SHA-256 over the rows in key order, without inserted_at.

    One hash over all rows has to read them in order: their text is streamed through the driver, a partition
    at a time. For a day's rollup; :func:`checksums` is for the whole of it.
    """
    digest = hashlib.sha256()
    for r in _tenant_texts(rollup).orderBy("tenant_id").toLocalIterator():
        digest.update(r["text"].encode())
    return digest.hexdigest()


def fast_checksum(rollup: DataFrame) -> DataFrame:
    """Order-free whole-table fingerprint in one aggregation: (rows, low, high), sums of two hashes of each row."""
    cols = ["tenant_id", "event_type", "date", "event_count", "total_value"]
    h = F.xxhash64(*cols).cast("decimal(20,0)")
    g = F.xxhash64(F.lit(7), *cols).cast("decimal(20,0)")
    return rollup.agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("low"), F.sum(g).cast("string").alias("high"))


def validate(events: DataFrame, sink: DataFrame, day: dt.date) -> None:
    """Source and sink of a day must agree; the error names both checksums and row counts."""
    source, stored = daily(events, day, day + dt.timedelta(days=1)), final_rollup(sink.where(F.col("date") == F.lit(day))).drop("inserted_at")
    a, b = checksum(source), checksum(stored)
    if a != b:
        raise ValueError(f"rollup of {day}: source {a} with {source.count()} rows, sink {b} with {stored.count()} rows")


def differences(events: DataFrame, sink: DataFrame) -> DataFrame:
    """Rows in which source and sink differ, with both sides' figures."""
    key = ["tenant_id", "event_type", "date"]
    a, b = daily(events).alias("a"), final_rollup(sink).alias("b")
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, cond, "full")
    same = F.col("a.event_count").eqNullSafe(F.col("b.event_count")) & F.col("a.total_value").eqNullSafe(F.col("b.total_value"))
    return both.where(~same).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], F.col("a.event_count").alias("source_count"),
                                    F.col("b.event_count").alias("sink_count"), F.col("a.total_value").alias("source_value"), F.col("b.total_value").alias("sink_value"))
