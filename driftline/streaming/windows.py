"""Event-time windows over a stream, with the exact per-event lateness of the batch operator.

Each micro-batch is classified in arrival order by the same SQL as a batch, starting from the watermark that earlier
batches reached. What it adds to windows, to late buckets and to the sets of applied event ids is written under its batch
id, so that a repeated batch replaces itself; the watermark is written last. A window is the sum of its
additions; it is final once the watermark has passed its end and the lateness.

State stays bounded. Applied ids lie by period, the window of on-time events or the day of late ones, and a batch reads only the
periods it touches; periods of windows older than four windows and twice the lateness are deleted. Every ``MERGE_EVERY`` batches what
was added by all before the last is merged to one sum per window, windows that old, which a sweep has written to history, left out.
A sweep appends closed windows to history once, and late buckets each time under a later flush time; the latest of a key holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions.scalar import duration_label, truncate_to
from driftline.operators import windows
from driftline.operators.final import latest
from driftline.operators.late_events import classify

ADDED = "tenant_id string, event_type string, window_start timestamp, is_late boolean, event_count long, sum_value double, duration string, batch long"
APPLIED = "tenant_id string, event_type string, window_start timestamp, is_late boolean, event_id string, duration string, period string, batch long"
HISTORY = "tenant_id string, event_type string, window_duration string, window_start timestamp, event_count long, sum_value double, is_late boolean, flushed_at timestamp, sweep long"
KEY = ["tenant_id", "event_type", "window_start", "is_late"]
MERGE_EVERY = 20


class WindowStream:
    def __init__(self, spark: SparkSession, root: str, durations: tuple[int, ...] = (60, 3600), lateness: int = windows.LATENESS):
        self.spark, self.root, self.durations, self.lateness = spark, root.rstrip("/"), durations, lateness

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if scratch.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def watermark(self, before: int | None = None):
        """Greatest event time of finished batches (before one); null at first."""
        w = self._read("watermarks", "wm timestamp, batch long")
        return (w if before is None else w.where(F.col("batch") < before)).agg(F.max("wm").alias("wm"))

    def process(self, events: DataFrame, batch_id: int) -> None:
        """One micro-batch: events with received_at and delivery_id."""
        wm = self.watermark(batch_id).select(F.date_format("wm", "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        marked = classify(events.withColumn("event_id", F.col("event_id").cast("string")), floor=wm).withColumn("is_late", F.col("fate") != "on_time")
        marked = scratch.table(marked, "stream-batch")
        for seconds in self.durations:
            label = duration_label(seconds)
            fresh = windows.first_deliveries(marked, seconds).withColumn("window_start", F.when(~F.col("is_late"), truncate_to("occurred_at", seconds)))
            period = F.when(F.col("is_late"), F.concat(F.lit("d"), F.unix_seconds(F.date_trunc("day", "occurred_at")))).otherwise(
                F.concat(F.lit("w"), F.coalesce(F.unix_seconds("window_start"), F.lit(0))))
            fresh = scratch.table(fresh.withColumn("period", period), "stream-first")
            # As many periods as a batch's events lie in.
            touched = [r["period"] for r in fresh.select("period").distinct().collect()]
            seen = self._read("applied", APPLIED).where((F.col("duration") == label) & F.col("period").isin(touched) & (F.col("batch") < batch_id))
            key = [*KEY, "event_id"]
            s = seen.select(*[F.col(k).alias(f"__{k}") for k in key])
            cond = F.lit(True)
            for k in key:
                cond = cond & fresh[k].eqNullSafe(s[f"__{k}"])
            first, fresh = fresh, scratch.table(fresh.join(s, cond, "left_anti"), "stream-fresh")
            scratch.drop(first)
            (fresh.select(*key, "period", F.lit(batch_id).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("period", "batch").parquet(f"{self.root}/applied/duration={label}"))
            windows_added = fresh.groupBy("tenant_id", "event_type", "window_start", "is_late").agg(
                F.count("*").alias("event_count"), windows.exact_sum(F.col("value")).alias("sum_value"))
            windows_added.write.mode("overwrite").parquet(f"{self.root}/added/duration={label}/batch={batch_id}")
            scratch.drop(fresh)
        marked.agg(F.max("occurred_at").alias("wm")).write.mode("overwrite").parquet(f"{self.root}/watermarks/batch={batch_id}")
        scratch.drop(marked)
        if (batch_id + 1) % MERGE_EVERY == 0:
            self.merge(batch_id)

    def _horizon(self, seconds: int, before: int | None = None) -> dt.datetime | None:
        """Windows that start before it take no more events: four windows and twice the lateness behind the watermark."""
        top = self.watermark(before).select(F.unix_seconds("wm")).first()[0]
        return None if top is None else dt.datetime.fromtimestamp(top - 4 * seconds - 2 * self.lateness, dt.timezone.utc)

    def merge(self, last: int) -> None:
        """Merge what batches before ``last`` added, which may come again, and delete what is too old to be touched."""
        self.sweep()
        for seconds in self.durations:
            label, horizon = duration_label(seconds), self._horizon(seconds, last)
            if horizon is None:
                continue
            rows = self._sums(label, last - 1)
            rows = rows.where(F.col("is_late") | (F.col("window_start") >= F.lit(horizon)))
            rows.write.mode("overwrite").parquet(f"{self.root}/merged/duration={label}/upto={last - 1}")
            for name in scratch.names(self.spark, f"{self.root}/merged/duration={label}"):
                if int(name.partition("=")[2]) < last - 1:
                    scratch.remove(self.spark, f"{self.root}/merged/duration={label}/{name}")
            for name in scratch.names(self.spark, f"{self.root}/added/duration={label}"):
                if int(name.partition("=")[2]) < last:
                    scratch.remove(self.spark, f"{self.root}/added/duration={label}/{name}")
            for name in scratch.names(self.spark, f"{self.root}/applied/duration={label}"):
                at = name.partition("=")[2]
                if at.startswith("w") and int(at[1:]) < horizon.timestamp():  # the days of late ids stay
                    scratch.remove(self.spark, f"{self.root}/applied/duration={label}/{name}")

    def _sums(self, label: str, last: int | None = None) -> DataFrame:
        """What was added to each window by batches up to ``last``: the merged sums, and what came after them."""
        done = [n.partition("=")[2] for n in scratch.names(self.spark, f"{self.root}/merged/duration={label}") if scratch.exists(self.spark, f"{self.root}/merged/duration={label}/{n}/_SUCCESS")]
        upto = max(map(int, done), default=-1)
        rows = self._read("added", ADDED).where((F.col("duration") == label) & (F.col("batch") > upto))
        if last is not None:
            rows = rows.where(F.col("batch") <= last)
        figures = [*KEY, "event_count", "sum_value"]
        rows = rows.select(*figures)
        if upto >= 0:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.root}/merged/duration={label}/upto={upto}").select(*figures))
        return rows.groupBy(*KEY).agg(F.sum("event_count").alias("event_count"), windows.exact_sum(F.col("sum_value")).alias("sum_value"))

    def state(self, seconds: int) -> DataFrame:
        """(tenant_id, event_type, window_start, is_late, event_count, sum_value, is_closed) as of the last batch, of windows that are not too old."""
        closed = F.col("is_late") | windows.is_closed(F.col("window_start"), seconds, self.watermark().scalar(), self.lateness)
        return self._sums(duration_label(seconds)).withColumn("is_closed", F.coalesce(closed, F.lit(False)))

    def sweep(self, flushed_at: dt.datetime | None = None) -> None:
        """Append to history the closed windows that aren't there yet, and all late buckets; a late bucket's start is the flush time."""
        done = [int(n.partition("=")[2]) for n in scratch.names(self.spark, f"{self.root}/history")]
        number, at = max(done, default=0) + 1, F.lit(flushed_at or dt.datetime.now(dt.timezone.utc))
        closed = None
        for seconds in self.durations:
            one = self.flushed(seconds).withColumn("window_duration", F.lit(duration_label(seconds)))
            closed = one if closed is None else closed.unionByName(one)
        there = self._read("history", HISTORY).where(~F.col("is_late")).select(*[F.col(c).alias(f"__{c}") for c in (*KEY, "window_duration")])
        cond = F.lit(True)
        for c in (*KEY, "window_duration"):
            cond = cond & closed[c].eqNullSafe(there[f"__{c}"])
        new = closed.join(there, cond, "left_anti").withColumn("window_start", F.when(F.col("is_late"), F.date_trunc("second", at)).otherwise(F.col("window_start")))
        new.withColumn("flushed_at", at).write.parquet(f"{self.root}/history/sweep={number}")

    def history(self) -> DataFrame:
        """Windows as flushed: each closed window once, each late bucket as last flushed."""
        rows = self._read("history", HISTORY).drop("sweep")
        late = latest(rows.where("is_late"), ["tenant_id", "event_type", "window_duration"], ["flushed_at"])
        return latest(rows.where("NOT is_late"), ["tenant_id", "event_type", "window_duration", "window_start"], ["flushed_at"]).unionByName(late)

    def flushed(self, seconds: int) -> DataFrame:
        """Closed windows and late buckets, as written to history."""
        return self.state(seconds).where("is_closed").drop("is_closed")

    def frames(self, seconds: int, now: dt.datetime) -> DataFrame:
        """(tenant_id, event_type, window_label, window_start, event_count, sum_value, based_on, watermark, observed_at) of all tenants and types
        seen: the window that holds the watermark, or before there is one, that of ``now``, without counts."""
        figures = self.state(seconds)
        at = self.watermark().scalar()
        start = truncate_to(F.coalesce(at, F.lit(now)), seconds)
        keys = figures.select("tenant_id", "event_type").distinct().withColumn("window_start", start)
        got = keys.join(figures.where(~F.col("is_late")).select(*KEY[:3], "event_count", "sum_value"), KEY[:3], "left")
        return got.select("tenant_id", "event_type", F.lit(duration_label(seconds)).alias("window_label"), "window_start", F.coalesce("event_count", F.lit(0)).alias("event_count"),
                          F.coalesce("sum_value", F.lit(0.0)).alias("sum_value"), F.when(at.isNull(), "wall_clock").otherwise("watermark").alias("based_on"),
                          at.alias("watermark"), F.lit(now).alias("observed_at"))

    def live(self, seconds: int) -> DataFrame:
        """The window that holds the watermark."""
        top = self.watermark().select(truncate_to("wm", seconds)).scalar()
        return self.state(seconds).where(~F.col("is_late") & (F.col("window_start") == top)).select("tenant_id", "event_type", "window_start", "event_count", "sum_value")


def run(spark: SparkSession, source: DataFrame, root: str, durations: tuple[int, ...] = (60, 3600), columnar: str | None = None) -> WindowStream:
    """Drain a streaming DataFrame of arrivals through the windows, and the events to columnar storage after them."""
    ws = WindowStream(spark, root, durations)

    def each(batch: DataFrame, batch_id: int) -> None:
        ws.process(batch, batch_id)
        if columnar:
            batch.write.mode("overwrite").parquet(f"{columnar}/batch={batch_id}")

    source.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ws


def native(stream: DataFrame, width: str, lateness: str = "30 seconds") -> DataFrame:
    """Spark's own windows: lateness by window rather than by event, watermark moved between micro-batches."""
    return (stream.withWatermark("occurred_at", lateness).groupBy(F.window("occurred_at", width).alias("w"), "tenant_id", "event_type")
            .agg(F.count("*").alias("event_count"), F.sum("value").alias("sum_value"))
            .select("tenant_id", "event_type", F.col("w.start").alias("window_start"), "event_count", "sum_value"))
