"""Tenants on shards: layout, distribution, load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalar import limit_or, month_partition, shard_of

SHARDS = 4


def with_shard(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    return df.withColumn("shard", shard_of("tenant_id", shards))


def write(events: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Events partitioned by shard and month, sorted by tenant and time for row-group statistics."""
    rows = with_shard(events, shards).withColumn("month", month_partition("occurred_at"))
    (rows.repartition("shard", "month").sortWithinPartitions("tenant_id", "occurred_at").write.mode("append").partitionBy("shard", "month").parquet(path))


def read_tenant(spark: SparkSession, path: str, tenant: str, shards: int = SHARDS) -> DataFrame:
    """One tenant's events: only its shard's partitions are read."""
    shard = spark.range(1).select(shard_of(F.lit(tenant), shards)).first()[0]
    return spark.read.parquet(path).where((F.col("shard") == shard) & (F.col("tenant_id") == tenant))


def distribution(events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, tenants, events, last_event), empty shards included. Rows collapse per tenant before anything meets."""
    per_tenant = events.groupBy("tenant_id").agg(F.count("*").alias("n"), F.max("occurred_at").alias("last"))
    got = with_shard(per_tenant, shards).groupBy("shard").agg(F.count("*").alias("tenants"), F.sum("n").alias("events"), F.max("last").alias("last_event"))
    every = events.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(F.broadcast(got), "shard", "left").select(
        "shard", F.coalesce("tenants", F.lit(0)).alias("tenants"), F.coalesce("events", F.lit(0)).alias("events"), "last_event")


def tenants_of_shards(tenants: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, tenant_id) rows rather than a list per shard, which would grow with the tenants."""
    return with_shard(tenants.select("tenant_id").distinct(), shards).select("shard", "tenant_id")


def top_tenants(events: DataFrame, k: int | None = None, shards: int = SHARDS) -> DataFrame:
    """The k busiest tenants: (tenant_id, shard, events); each task keeps its own k before they merge."""
    counts = events.groupBy("tenant_id").agg(F.count("*").alias("events"))
    return with_shard(counts.orderBy(F.desc("events"), "tenant_id").limit(limit_or(k, 50, 1000)), shards).select("tenant_id", "shard", "events")
