"""Queries p2 and p4 to p7: skew, deduplication, lateness, features, trailing totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import scratch
from driftline.operators import features, hot_keys, late_events, trailing
from driftline.operators.message_store import MessageStore
from driftline.sources.tables import read

HOT_SHARE = 0.02


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.hot(hot_keys.histograms(read(spark, d, "usage_events"), "tenant_id", "value"), HOT_SHARE).select(F.col("key").alias("tenant_id"))


def p2_tenant_profile(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys.profile(read(spark, d, "usage_events"), "tenant_id", "value")


def p2_tenant_load(spark: SparkSession, d: str) -> DataFrame:
    got = hot_keys.profile(read(spark, d, "tenant_load"), "tenant_id", "events", [500])
    return got.select("tenant_id", F.col("rows").alias("weeks"), F.col("total").cast("long").alias("load"),
                      F.col("p50").cast("long").alias("median_week"))


#: Runs in which all deliveries are upserted.
RUNS = 4


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries, upserted as runs by range of receipt; copies in different runs meet in storage, by compaction."""
    events = read(spark, d, "usage_events")
    at = F.col("received_at").cast("timestamp")
    cuts = events.agg(F.percentile_approx(F.unix_micros(at), [i / RUNS for i in range(1, RUNS)]).alias("c")).first()["c"] or []
    store = MessageStore(spark)
    edges = [None, *sorted(set(cuts)), None]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        # Compared as timestamps, so that the range reaches the scan.
        within = (F.lit(True) if low is None else at > F.timestamp_micros(F.lit(low))) & (F.lit(True) if high is None else at <= F.timestamp_micros(F.lit(high)))
        store.upsert(events.where(within | at.isNull() if i == 0 else within), f"received_{i}")
    store.compact()
    messages = store.messages()
    store.close()
    return messages


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).where("copies > 1").select("tenant_id", "event_id")


def p4_messages(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("tenant_id", "event_id", "delivery_id", _ntz("occurred_at"), "batch_id", "copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "usage_events").select("delivery_id", "occurred_at", "received_at")
    return late_events.late_rows(late_events.classify(events))


def p5_revisions(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "usage_events").select("delivery_id", "tenant_id", "event_type", "value", "occurred_at", "received_at")
    return late_events.revisions(late_events.classify(events)).select(
        "tenant_id", "event_type", _ntz("period_start"), _ntz("arrival_start"), F.col("revision").cast("long").alias("revision"), "event_count", "sum_value", "late_count", "is_final")


#: Permille of deliveries, by receipt, that are loaded first; the rest arrives afterwards.
LOADED_FIRST = 900


def _feature_store(spark: SparkSession, d: str):
    """(store, as_of, events): all days of the first deliveries were loaded, then only the days that the later ones change.

    as_of is the last event's time, within its day, whose events come from the events themselves.
    """
    events = read(spark, d, "usage_events").select("tenant_id", "event_type", "value", "occurred_at", "received_at")
    at = F.col("received_at").cast("timestamp")
    ends = events.agg(F.percentile_approx(F.unix_micros(at), LOADED_FIRST / 1000).alias("cut"), F.max(F.unix_micros(F.col("occurred_at").cast("timestamp"))).alias("last")).first()
    as_of = dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=ends["last"] or 0)
    store = features.FeatureStore(spark)
    later = at > F.timestamp_micros(F.lit(ends["cut"]))
    store.load(events.where(~F.coalesce(later, F.lit(False))))
    store.load(events, store.changed_days(events.where(later)))
    return store, as_of, events


def p6_features(spark: SparkSession, d: str) -> DataFrame:
    store, as_of, events = _feature_store(spark, d)
    return store.features(as_of, events=events).withColumnRenamed("entity", "tenant_id")


def p6_by_type(spark: SparkSession, d: str) -> DataFrame:
    store, as_of, events = _feature_store(spark, d)
    got = store.by_type(as_of, events=events)
    return got.select(F.col("entity").alias("tenant_id"), "event_type", F.col("n").alias("event_count"), F.col("total").alias("total_value"),
                      ((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_at")) / 1e6).alias("recency_s"))


#: Batches in which the rollup's rows reach the trailing totals.
BATCHES = 4


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    """State after the rollup's rows came in batches by range of inserted_at: later batches bring new days and correct old ones."""
    stats = read(spark, d, "tenant_daily_stats")
    at = F.col("inserted_at").cast("timestamp")
    cuts = stats.agg(F.percentile_approx(F.unix_micros(at), [i / BATCHES for i in range(1, BATCHES)]).alias("c")).first()["c"] or []
    store, edges = trailing.TrailingStore(spark), [None, *sorted(set(cuts)), None]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        within = (F.lit(True) if low is None else at > F.timestamp_micros(F.lit(low))) & (F.lit(True) if high is None else at <= F.timestamp_micros(F.lit(high)))
        store.apply(stats.where(within | at.isNull() if i == 0 else within))
    return store.state()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = trailing.long_form(_trailing(spark, d)).where("event_count = 0")
    return rows.select(F.col("entity").alias("tenant_id"), F.date_format("day", "yyyy-MM-dd").alias("day"), "span")


def p7_trailing(spark: SparkSession, d: str) -> DataFrame:
    return trailing.long_form(_trailing(spark, d)).withColumnRenamed("entity", "tenant_id")


QUERIES = {f.__name__: f for f in (
    p2_found, p2_tenant_profile, p2_tenant_load, p4_found,
    p4_messages, p5_found, p5_revisions, p6_features, p6_by_type, p7_found, p7_trailing)}

_SUM = "coalesce(cast(sum(cast(value as decimal(28,4))) as double), 0)"


def _ranked(groups: str, permille: list[int], source: str = "usage_events") -> str:
    """Percentiles by row_number: the value at rank ceil(n * p / 1000)."""
    picks = ", ".join(f"max(value) FILTER (WHERE r = greatest(1, (n * {p} + 999) // 1000)) AS p{p // 10}" for p in permille)
    return (f"SELECT {groups}, max(n) AS \"values\", {picks} FROM (SELECT {groups}, value + 0.0 AS value, row_number() OVER (PARTITION BY {groups} ORDER BY value + 0.0) AS r, "
            f"count(*) OVER (PARTITION BY {groups}) AS n FROM {source} WHERE value IS NOT NULL) GROUP BY {groups}")


_ID = "regexp_replace(lower(trim(event_id)), '^urn:uuid:|[{}-]', '', 'g')"
_UUID = f"substr({_ID},1,8)||'-'||substr({_ID},9,4)||'-'||substr({_ID},13,4)||'-'||substr({_ID},17,4)||'-'||substr({_ID},21,12)"
_MARKED = """SELECT *, max(occurred_at) OVER (ORDER BY received_at, delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM usage_events"""
_TRAILING = """
    WITH valid AS (
        SELECT tenant_id, event_type, date AS day, arg_max(event_count, (inserted_at, event_count, total_value)) AS n,
               arg_max(coalesce(total_value, 0), (inserted_at, event_count, total_value)) AS v
        FROM tenant_daily_stats GROUP BY ALL
    ), daily AS (
        SELECT tenant_id, day, cast(sum(n) as bigint) AS n, sum(cast(v as decimal(28,4))) AS v FROM valid GROUP BY ALL
    ), span AS (
        SELECT tenant_id, min(day) AS a, max(day) AS z FROM daily WHERE n > 0 GROUP BY 1
    ), grid AS (
        SELECT tenant_id, cast(unnest(generate_series(a::timestamp, z::timestamp, INTERVAL 1 DAY)) as date) AS day FROM span
    ), filled AS (
        SELECT g.tenant_id, g.day, coalesce(d.n, 0) AS n, coalesce(d.v, 0) AS v FROM grid g LEFT JOIN daily d USING (tenant_id, day)
    ), rolled AS (
        SELECT tenant_id, day, 7 AS span, sum(n) OVER w AS n, sum(v) OVER w AS v FROM filled
        WINDOW w AS (PARTITION BY tenant_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
        UNION ALL
        SELECT tenant_id, day, 30, sum(n) OVER w, sum(v) OVER w FROM filled
        WINDOW w AS (PARTITION BY tenant_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
    )"""

ORACLE = {
    "p2_found": "SELECT tenant_id FROM usage_events GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM usage_events)",
    "p2_tenant_profile": f"""
        SELECT t.tenant_id, t."rows", coalesce(p."values", 0) AS "values", t.total, p.p50, p.p90, p.p99
        FROM (SELECT tenant_id, count(*) AS "rows", {_SUM} AS total FROM usage_events GROUP BY 1) t
        LEFT JOIN ({_ranked("tenant_id", [500, 900, 990])}) p ON t.tenant_id = p.tenant_id""",
    "p2_tenant_load": """
        SELECT tenant_id, count(*) AS weeks, cast(sum(events) as bigint) AS load, max(events) FILTER (WHERE r = (n * 500 + 999) // 1000) AS median_week
        FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY events) AS r, count(*) OVER (PARTITION BY tenant_id) AS n FROM tenant_load)
        GROUP BY 1""",
    "p4_found": f"SELECT tenant_id, {_UUID} AS event_id FROM usage_events GROUP BY ALL HAVING count(*) > 1",
    "p4_messages": f"""
        SELECT tenant_id, event_id, delivery_id, occurred_at, batch_id, copies FROM (
            SELECT tenant_id, {_UUID} AS event_id, delivery_id, occurred_at AT TIME ZONE 'UTC' AS occurred_at, batch_id,
                   count(*) OVER m AS copies, row_number() OVER (PARTITION BY tenant_id, {_ID} ORDER BY received_at, delivery_id) AS r
            FROM usage_events WINDOW m AS (PARTITION BY tenant_id, {_ID})) WHERE r = 1""",
    "p5_found": f"""
        SELECT delivery_id, CASE WHEN occurred_at < wm - INTERVAL 2 DAY THEN 'dropped' ELSE 'corrects' END AS fate
        FROM ({_MARKED}) WHERE occurred_at < wm - INTERVAL 30 SECOND""",
    "p5_revisions": f"""
        WITH cells AS (
            SELECT tenant_id, event_type, date_trunc('hour', occurred_at AT TIME ZONE 'UTC') AS period_start,
                   date_trunc('hour', received_at AT TIME ZONE 'UTC') AS arrival_start, count(*) AS n,
                   count(*) FILTER (WHERE occurred_at < wm - INTERVAL 30 SECOND) AS late, sum(cast(value as decimal(28,4))) AS v
            FROM ({_MARKED}) WHERE NOT coalesce(occurred_at < wm - INTERVAL 2 DAY, false) GROUP BY ALL)
        SELECT tenant_id, event_type, period_start, arrival_start, row_number() OVER w AS revision, cast(sum(n) OVER w as bigint) AS event_count,
               coalesce(cast(sum(v) OVER w as double), 0) AS sum_value, cast(sum(late) OVER w as bigint) AS late_count,
               lead(arrival_start) OVER (PARTITION BY tenant_id, event_type, period_start ORDER BY arrival_start) IS NULL AS is_final
        FROM cells WINDOW w AS (PARTITION BY tenant_id, event_type, period_start ORDER BY arrival_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "p6_by_type": f"""
        SELECT tenant_id, coalesce(event_type, '(null)') AS event_type, count(*) AS event_count, {_SUM} AS total_value,
               (epoch_us((SELECT max(occurred_at) FROM usage_events)) - epoch_us(max(occurred_at))) / 1e6 AS recency_s
        FROM usage_events GROUP BY 1, 2""",
    "p7_found": f"{_TRAILING} SELECT tenant_id, strftime(day, '%Y-%m-%d') AS day, span FROM rolled WHERE n = 0",
    "p7_trailing": f"""{_TRAILING} SELECT tenant_id, day, span, cast(n as bigint) AS event_count, cast(v as double) AS total_value,
        cast(n as double) / span AS avg_count, cast(v as double) / span AS avg_value FROM rolled""",
}
