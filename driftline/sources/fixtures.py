"""The test tables read as the engine's tables: events, redeliveries, log, tenants, ledger, metrics.

Events of the star schema: user is the tenant, props the payload; arrival is jittered by a rule so that
events come late and out of order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.sources.tables import read


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("tenant_id"), "event_type", F.col("props").alias("payload"), "value",
        F.col("ts").cast("timestamp").alias("occurred_at"))


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Events with received_at and delivery_id: their order of arrival."""
    jitter = F.make_dt_interval(secs=((F.col("event_id") * 7919) % 7200).cast("decimal(18,6)"))
    return events(spark, d).select("*", (F.col("occurred_at") + jitter).alias("received_at"), F.col("event_id").alias("delivery_id"))


def redelivered(e: DataFrame) -> DataFrame:
    """Every tenth event delivered twice."""
    return e.unionByName(e.where("event_id % 10 = 0"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """The event log the events were ingested through."""
    e = events(spark, d)
    data = F.to_json(F.struct("tenant_id", "event_type", "payload", "value", F.col("event_id").cast("string").alias("id")))
    return e.select((F.col("event_id") + 1).alias("stream_position"), F.concat(F.lit("tenant-"), F.col("tenant_id")).alias("stream_name"),
                    F.lit("EventIngested").alias("event_type"), data.alias("data"), F.lit("{}").alias("metadata"), "occurred_at")


def tenants(spark: SparkSession, d: str) -> DataFrame:
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "free").when(F.col("c_mktsegment").isin("AUTOMOBILE", "HOUSEHOLD"), "pro").otherwise("enterprise")
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), plan.alias("plan"))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("tenant_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_cents"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderstatus") == "O").alias("pending"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: path, status 500 for errors, duration in seconds."""
    return events(spark, d).select(
        F.col("occurred_at").alias("ts"), F.lit("GET").alias("method"), F.col("event_type").alias("path"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"), (F.col("value") / 1000).alias("duration"))


#: Methods and paths that event types stand for as requests.
ROUTES = {"view": ("GET", "/api/v1/events"), "click": ("POST", "/api/v1/events"), "signup": ("POST", "/api/v1/tenants"), "purchase": ("GET", "/api/v1/tenants/{id}"), "error": ("GET", "/api/v1/events/search")}


def http(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests of the service's routes; every tenth is the scraping of the metrics."""
    def route(i: int):
        of = F.create_map(*[F.lit(x) for kind, r in ROUTES.items() for x in (kind, r[i])])
        return F.element_at(of, F.col("event_type"))

    scrape = F.col("event_id") % 10 == 9
    return events(spark, d).select(
        F.col("occurred_at").alias("ts"), F.when(scrape, "GET").otherwise(route(0)).alias("method"), F.when(scrape, "/api/v1/metrics").otherwise(route(1)).alias("path"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0), "500").otherwise("200").alias("status"), (F.col("value") / 200).alias("duration"))


def generate(spark: SparkSession, n: int = 10_000, seed: int = 42, days: int = 30, tenants: int = 6) -> DataFrame:
    """Synthetic events for demonstrations: fixed seed, a third with personal data in the payload."""
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (F.rand(seed + k) * len(words)).cast("int") + 1)
    base = spark.range(n).select(
        F.col("id").alias("event_id"), (F.rand(seed) * tenants).cast("int").cast("string").alias("tenant_id"),
        # The event types, pages and fields of the demonstration data.
        pick(["page_view", "click", "purchase", "signup", "logout", "api_call"], 1).alias("event_type"),
        F.round(F.rand(seed + 2) * 100, 2).alias("value"), (F.rand(seed + 3) * days * 24).cast("int").alias("hour"), (F.rand(seed + 4) < 0.3).alias("personal"))
    start = F.lit("2024-01-01").cast("timestamp")
    payload = F.to_json(F.struct(
        pick(["/", "/pricing", "/docs"], 5).alias("page"), (F.rand(seed + 6) * 1000).cast("int").alias("duration_ms"),
        F.when(F.col("personal"), F.concat(F.lit("user"), F.col("event_id"), F.lit("@example.com"))).alias("user_email"),
        F.when(F.col("personal"), F.lit("203.0.113.7")).alias("client_ip")))
    return base.select("event_id", "tenant_id", "event_type", payload.alias("payload"), "value",
                       (start + F.make_dt_interval(hours=F.col("hour"))).alias("occurred_at"))
