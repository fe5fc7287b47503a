"""One row per entity with count, recency and total of each event type.

Events become partial aggregates per (day, entity, type), kept in a store partitioned by day. A
feature table merges the days it needs; at the edges of its span, part-days are taken from the events
themselves. When events arrive, only the days they touch are recomputed; all others stay as they are.
A hot entity is at most one row per day and type before anything is grouped by entity.

Features are sparse maps from type to figure, so a row is as wide as the entity is active and the
number of types is unbounded; :func:`as_columns` spreads them for a given list of types.

Defined results: a null type is '(null)', the empty type ''; types not in any list are types too; a
null entity is an entity; null and NaN values count as events and add 0; null times count in no day and
are left out; an entity without events in the span has no row (left join the dimension for zeros); an
empty table gives no rows; recency is in seconds from ``as_of`` back to the type's last event.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions.ordered import exact_sum

PARTIAL = "entity string, event_type string, n bigint, total double, last_at timestamp, day date"


def partials(events: DataFrame, entity: str = "tenant_id") -> DataFrame:
    """(entity, event_type, n, total, last_at, day) per day bucket."""
    return (
        events.where(F.col("occurred_at").isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.coalesce("event_type", F.lit("(null)")).alias("event_type"),
                 F.to_date("occurred_at").alias("day"))
        .agg(F.count("*").alias("n"), exact_sum(F.col("value").cast("double")).alias("total"), F.max("occurred_at").alias("last_at"))
        .select("entity", "event_type", "n", "total", "last_at", "day")
    )


def _start(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(), dt.timezone.utc)


class FeatureStore:
    """Day buckets of partial aggregates under ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch.new_path(spark, "features")

    def load(self, events: DataFrame, days: list[dt.date] | None = None) -> None:
        """Recompute the buckets of ``days`` (all days of ``events`` if None) from the events of those days.

        Buckets of other days are not touched. A bucket whose events are gone is removed.
        """
        if days is not None:
            if not days:
                return
            # The range reaches the scan; the list leaves out days between.
            events = events.where((F.col("occurred_at") >= F.lit(_start(min(days)))) & (F.col("occurred_at") < F.lit(_start(max(days) + dt.timedelta(days=1)))))
            events = events.where(F.to_date("occurred_at").isin(days))
            for d in days:
                scratch.remove(self.spark, f"{self.path}/day={d.isoformat()}")
        # Rebalanced, so that a day is a few files, and a busy day more than one task.
        (partials(events).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(self.path))

    def changed_days(self, arrived: DataFrame) -> list[dt.date]:
        """Days that arriving events touch; as many as there are days, whatever the number of events."""
        rows = arrived.where(F.col("occurred_at").isNotNull()).select(F.to_date("occurred_at").alias("d")).distinct().collect()
        return sorted(r.d for r in rows)

    def buckets(self) -> DataFrame:
        if not scratch.exists(self.spark, self.path):
            return self.spark.createDataFrame([], PARTIAL)
        return self.spark.read.schema(PARTIAL).parquet(self.path)

    def by_type(self, as_of: dt.datetime, since: dt.datetime | None = None, events: DataFrame | None = None) -> DataFrame:
        """(entity, event_type, n, total, last_at) over events in [since, as_of].

        Whole days come from the buckets; the part-days at the edges from ``events``, whose
        filter reaches its scan. Without ``events`` the span is widened to whole days.
        """
        parts = self.buckets()
        first = since.date() if since else None
        if events is not None:
            # as_of may be inside its day, and since inside its own: those days come from the events.
            edge = F.col("occurred_at") >= F.lit(_start(as_of.date()))
            parts = parts.where(F.col("day") < F.lit(as_of.date()))
            if first:
                edge = edge | (F.col("occurred_at") < F.lit(_start(first + dt.timedelta(days=1))))
                parts = parts.where(F.col("day") > F.lit(first))
            span = (F.col("occurred_at") <= F.lit(as_of)) & edge
            if since:
                span = span & (F.col("occurred_at") >= F.lit(since))
            parts = parts.unionByName(partials(events.where(span)))
        else:
            parts = parts.where(F.col("day") <= F.lit(as_of.date()))
            if first:
                parts = parts.where(F.col("day") >= F.lit(first))
        return parts.groupBy("entity", "event_type").agg(
            F.sum("n").alias("n"), exact_sum(F.col("total")).alias("total"), F.max("last_at").alias("last_at"))

    def features(self, as_of: dt.datetime, since: dt.datetime | None = None, events: DataFrame | None = None) -> DataFrame:
        """(entity, events, types, last_at, counts, totals, recency_s), one row per entity."""
        t = self.by_type(as_of, since, events).withColumn(
            "recency", (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_at")) / 1e6)
        # One struct per type the entity has: bounded by the number of types.
        got = t.groupBy("entity").agg(
            F.sum("n").alias("events"), F.count("*").alias("types"), F.max("last_at").alias("last_at"),
            F.array_sort(F.collect_list(F.struct("event_type", "n", "total", "recency"))).alias("f"))
        return got.select("entity", "events", "types", "last_at", F.map_from_arrays("f.event_type", "f.n").alias("counts"),
                          F.map_from_arrays("f.event_type", "f.total").alias("totals"),
                          F.map_from_arrays("f.event_type", "f.recency").alias("recency_s"))


def as_columns(features: DataFrame, types: list[str]) -> DataFrame:
    """Spread the maps to three columns per listed type: count (0 if none), total (0), recency (null)."""
    cols = []
    for t in types:
        cols += [F.coalesce(F.try_element_at("counts", F.lit(t)), F.lit(0)).alias(f"{t}__count"),
                 F.coalesce(F.try_element_at("totals", F.lit(t)), F.lit(0.0)).alias(f"{t}__total"),
                 F.try_element_at("recency_s", F.lit(t)).alias(f"{t}__recency_s")]
    return features.select("entity", "events", "types", "last_at", *cols)
