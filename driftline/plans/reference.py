"""Queries of the analytics platform's own operators, with the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalar as S
from driftline.operators import final, ingest, keys, ledger, machines, masking, privacy, projections, rollup, search, shard, slo, windows
from driftline.sources import event_log, fixtures
from driftline.sources.tables import read

TENANT = "7"
FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
NOW = dt.datetime(2024, 1, 15, 12)


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of the nightly rollup: the second with other totals."""
    run = rollup.daily(fixtures.events(spark, d))
    stamp = lambda n: F.timestamp_seconds(F.lit(n))
    return run.withColumn("inserted_at", stamp(1)).unionByName(run.withColumn("total_value", F.col("total_value") + 1.0).withColumn("inserted_at", stamp(2)))


def _marked(spark, d):
    return windows.with_watermark(fixtures.arrivals(spark, d))


def _marked_redelivered(spark, d):
    a = fixtures.arrivals(spark, d)
    again = a.where("event_id % 10 = 0").withColumn("delivery_id", F.col("delivery_id") + 1_000_000_000)
    return windows.with_watermark(a.unionByName(again))


def daily_rollup_all(spark, d):
    return rollup.daily(fixtures.events(spark, d))


def daily_rollup_range(spark, d):
    return rollup.daily(fixtures.events(spark, d), dt.date(2024, 1, 5), dt.date(2024, 1, 12))


def daily_rollup_final(spark, d):
    return final.final_rollup(_versions(spark, d)).drop("inserted_at")


def rollup_fingerprint(spark, d):
    """Source and sink agree: the differences of a rollup and its stored run; none."""
    run = rollup.daily(fixtures.events(spark, d)).withColumn("inserted_at", F.timestamp_seconds(F.lit(1)))
    return rollup.differences(fixtures.events(spark, d), run).select("tenant_id", "event_type", "date")


def rollup_checksum(spark, d):
    """One checksum per tenant over the whole rollup."""
    return rollup.checksums(rollup.daily(fixtures.events(spark, d)))


def olap_daily_stats(spark, d):
    return rollup.tenant_days(fixtures.redelivered(fixtures.events(spark, d)), TENANT, FIRST, LAST)


def rowstore_daily_stats(spark, d):
    return rollup.tenant_days(fixtures.redelivered(fixtures.events(spark, d)), TENANT, FIRST, LAST, dedup=False)


def dedup_final(spark, d):
    return final.final_events(fixtures.redelivered(fixtures.events(spark, d))).select("tenant_id", "event_id", _ntz("occurred_at"), "event_type", "value")


def running_totals(spark, d):
    return projections.RunningTotals().transform(fixtures.log(spark, d))


def daily_event_counts(spark, d):
    return projections.DailyCounts().transform(fixtures.log(spark, d))


def incremental_totals(spark, d):
    """Running totals reached in two catch-ups instead of one."""
    from driftline import scratch
    log, root, p = fixtures.log(spark, d), scratch.new_path(spark, "projection"), projections.RunningTotals()
    p.catch_up(log, root, head=event_log.head(log) // 2)
    p.catch_up(log, root)
    return p.state(spark, root)


def watermark_trace(spark, d):
    return _marked(spark, d).select("event_id", _ntz("watermark"), "is_late")


def window_1m_ontime(spark, d):
    return windows.tumbling(_marked(spark, d), 60).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def window_1h_ontime(spark, d):
    return windows.tumbling(_marked(spark, d), 3600).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def window_7d_ontime(spark, d):
    return windows.tumbling(_marked(spark, d), 7 * 86400).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def late_bucket_1m(spark, d):
    return windows.late_bucket(_marked(spark, d), 60)


def late_bucket_1h(spark, d):
    return windows.late_bucket(_marked(spark, d), 3600)


def window_closed(spark, d):
    m = _marked(spark, d)
    top = m.agg(F.max("watermark")).scalar()
    starts = m.where("NOT is_late").select(S.truncate_to("occurred_at", 3600).alias("window_start")).distinct()
    return starts.select(_ntz("window_start"), windows.is_closed(F.col("window_start"), 3600, top).alias("is_closed"))


def window_stats_history(spark, d):
    return windows.history(_marked(spark, d), 3600).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def window_idempotent(spark, d):
    got = windows.tumbling(windows.first_deliveries(_marked_redelivered(spark, d), 3600), 3600)
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def live_snapshot(spark, d):
    return windows.live_frames(_marked(spark, d), 3600).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def recent_events(spark, d):
    return search.recent(fixtures.events(spark, d)).select(F.col("event_id").alias("id"), "event_type", "value", _ntz("occurred_at"))


def search_payload(spark, d):
    return search.search(fixtures.events(spark, d), '"k": 9').select(F.col("event_id").alias("id"), "event_type", "payload", _ntz("occurred_at"))


def point_lookup(spark, d):
    return search.get(fixtures.tenants(spark, d), id=TENANT)


def read_stream(spark, d):
    return event_log.stream(fixtures.log(spark, d), f"tenant-{TENANT}").select("stream_position", "event_type", _ntz("occurred_at"))


def cursor_scan(spark, d):
    return event_log.after(fixtures.log(spark, d), 500, 1000).select("stream_position", "stream_name")


def head_position(spark, d):
    return fixtures.log(spark, d).agg(F.coalesce(F.max("stream_position"), F.lit(0)).alias("head"))


def projection_lag(spark, d):
    at = spark.createDataFrame([("tenant_stats", 90), ("daily_event_counts", 50), ("ahead", 10_000_000)], "projection string, last_position long")
    return projections.lag(at, fixtures.log(spark, d))


def log_positions_all(spark, d):
    """Positions assigned to the whole table in order, after 1000."""
    e = fixtures.events(spark, d)
    return event_log.positions(e.select("event_id", "occurred_at"), 1000, ["occurred_at", "event_id"]).select("event_id", "stream_position")


def shard_index(spark, d):
    return shard.with_shard(fixtures.events(spark, d).select("tenant_id").distinct())


def shard_distribution(spark, d):
    return shard.distribution(fixtures.events(spark, d)).withColumn("last_event", F.col("last_event").cast("timestamp_ntz"))


def shard_tenants(spark, d):
    got = shard.tenants_of_shards(fixtures.events(spark, d).select("tenant_id"))
    return got.groupBy("shard").agg(F.count("*").alias("tenant_count"))


def top_tenants(spark, d):
    return shard.top_tenants(fixtures.events(spark, d), 20)


def _keys(spark, d):
    t = fixtures.tenants(spark, d)
    mine = t.select(F.concat(F.lit("key-"), "id").alias("key_id"), F.col("id").alias("tenant_id"), F.lit("tenant").alias("scope"),
                    F.when(F.col("id").cast("long") % 7 == 0, F.timestamp_seconds(F.lit(1))).alias("revoked_at"))
    admin = spark.range(1).select(F.lit("key-admin").alias("key_id"), F.lit(None).cast("string").alias("tenant_id"), F.lit("admin").alias("scope"),
                                  F.lit(None).cast("timestamp").alias("revoked_at"))
    return mine.unionByName(admin)


def tenant_lookup_join(spark, d):
    return keys.with_tenant(_keys(spark, d), fixtures.tenants(spark, d)).select("key_id", "tenant_id", "scope", "plan")


def insert_ignore(spark, d):
    """Every tenant gets a zero credit row unless it has one."""
    have = fixtures.tenants(spark, d).where(F.col("id").cast("long") % 2 == 0).select(F.col("id").alias("tenant_id"), F.lit(5).cast("long").alias("balance_cents"))
    new = fixtures.tenants(spark, d).select(F.col("id").alias("tenant_id"), F.lit(0).cast("long").alias("balance_cents"))
    return have.unionByName(final.anti_insert(new, have, ["tenant_id"]))


def _tables(spark, d):
    ev, log = fixtures.events(spark, d), fixtures.log(spark, d)
    return {"tenants": fixtures.tenants(spark, d), "events": ev, "event_log": log, "tenant_event_counts": running_totals(spark, d),
            "daily_event_counts": daily_event_counts(spark, d), "billing_records": fixtures.ledger(spark, d)}


def erase_tenant(spark, d):
    left = privacy.erase(_tables(spark, d), TENANT)
    out = None
    for name, df in sorted(left.items()):
        one = df.agg(F.count("*").alias("remaining")).select(F.lit(name).alias("table_name"), "remaining")
        out = one if out is None else out.unionByName(one)
    return out


def anonymise_docs(spark, d):
    return masking.mask(read(spark, d, "documents").select("doc_id", "text"), "text")


def anonymise_log(spark, d):
    log = fixtures.log(spark, d).withColumn("data", F.regexp_replace("data", '\\{\\\\"k\\\\": 9', '{\\\\\\\\"mail\\\\\\\\": \\\\\\\\"a@b.example\\\\\\\\", \\\\\\\\"k\\\\\\\\": 9'))
    return privacy.anonymise_log(log, TENANT)[1]


def pii_scan(spark, d):
    return masking.scan(read(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


def pii_category_counts(spark, d):
    return masking.category_counts(read(spark, d, "documents").select("text"), "text")


def export_tenant(spark, d):
    got = privacy.export_summary(fixtures.events(spark, d), TENANT)
    return got.select("tenant_id", "n_events", _ntz("first_ts"), _ntz("last_ts"))


def _consent(spark, d):
    changes = fixtures.events(spark, d).where("event_type IN ('signup', 'error')").select(
        "tenant_id", F.lit("analytics").alias("purpose"), F.when(F.col("event_type") == "signup", "grant").otherwise("revoke").alias("action"), F.col("event_id").alias("seq"))
    return privacy.consent(changes)


def consent_state(spark, d):
    tenants = fixtures.events(spark, d).select("tenant_id", F.lit("analytics").alias("purpose")).distinct()
    return privacy.consent_state(tenants, _consent(spark, d))


def consent_gate(spark, d):
    return privacy.gate(fixtures.events(spark, d), _consent(spark, d), "analytics").groupBy("tenant_id").agg(F.count("*").alias("event_count"))


def _tokens(spark, d):
    return fixtures.events(spark, d).select("event_id", "tenant_id", ((F.col("event_id") * 7919) % 1000 + 1).alias("token"))


def fencing_accept(spark, d):
    return machines.fencing(_tokens(spark, d)).select("event_id", "token", "accepted")


def fencing_per_tenant(spark, d):
    return machines.fencing(_tokens(spark, d), key=["tenant_id"]).select("event_id", "token", "accepted")


def skew_clamp(spark, d):
    e = fixtures.events(spark, d)
    return e.select("event_id", S.clamp_skew("occurred_at", F.lit(NOW).cast("timestamp")).cast("timestamp_ntz").alias("occurred_at"))


def ingest_validate(spark, d):
    e = fixtures.events(spark, d).withColumn("event_type", F.when(F.col("event_id") % 50 != 0, F.col("event_type")).otherwise(F.lit("")))
    return ingest.validate(e).select("event_id", "status", "code")


def batch_status(spark, d):
    e = fixtures.events(spark, d).withColumn("event_type", F.when(F.col("event_id") % 50 != 0, F.col("event_type")))
    return ingest.batch_status(ingest.validate(e))


def outbox_pending(spark, d):
    records = fixtures.ledger(spark, d).withColumn("outbox_sent_at", F.when(~F.col("pending"), F.col("created_at")))
    return ledger.pending(records, 100).select("id", "tenant_id", "amount_cents", _ntz("created_at"))


def credit_balance(spark, d):
    return ledger.balances(fixtures.tenants(spark, d), fixtures.ledger(spark, d).select("tenant_id", "amount_cents"))


def charge_fold(spark, d):
    led = fixtures.ledger(spark, d)
    opening = led.groupBy("tenant_id").agg((F.sum("amount_cents").cast("long") / 2).cast("long").alias("balance_cents"))
    charges = led.select("tenant_id", F.struct("created_at", "id").alias("seq"), F.concat(F.lit("k"), (F.col("id") % 9).cast("string")).alias("idempotency_key"), "amount_cents")
    return ledger.charge(opening, charges.withColumn("seq", F.unix_seconds("seq.created_at") * 10_000_000 + F.col("seq.id")))


def idempotency_first(spark, d):
    e = fixtures.events(spark, d).select(F.concat(F.lit("t:"), "tenant_id", F.lit(":"), "event_type").alias("ns_key"), F.col("event_id").alias("seq"),
                                         S.fingerprint(F.lit("POST"), F.lit("/events"), F.col("payload")).alias("fingerprint"))
    return machines.reservations(e).select("ns_key", "seq", "winner_id", "outcome")


def token_bucket(spark, d):
    e = fixtures.events(spark, d).select(F.col("tenant_id").alias("key"), (F.unix_micros("occurred_at") / 1e6).alias("at_s"), F.lit(0.0005).alias("rate"), F.lit(3.0).alias("burst"))
    return machines.token_bucket(e)


def breaker_transitions(spark, d):
    e = fixtures.events(spark, d).select(F.col("tenant_id").alias("key"), (F.unix_micros("occurred_at") / 1e6).alias("at_s"), (F.col("event_type") != "error").alias("ok"))
    return machines.transitions(machines.breaker(e, failures=2, interval=1e9, open_for=3600.0))


def ryow_route(spark, d):
    e = fixtures.events(spark, d)
    n = F.col("event_id")
    lsn = e.select("event_id", machines.required_lsn((n * 37) % 600 * (n % 2), F.lit(500)).alias("required_lsn"), ((n * 91) % 1000).alias("replay"), (n * 4096 % 20_000_000).alias("ahead"))
    return lsn.select("event_id", "required_lsn", machines.route(F.col("required_lsn"), F.col("replay")).alias("to_replica"),
                      S.lag_status(S.lag_bytes(F.col("replay") + F.col("ahead"), F.col("replay"))).alias("lag_status"))


def slo_histogram(spark, d):
    return slo.histogram(fixtures.metrics(spark, d), ["path"])


def slo_latency_quantile(spark, d):
    h = slo.histogram(fixtures.metrics(spark, d), ["path"])
    a, b = slo.quantile(h, ["path"], 0.95), slo.quantile(h, ["path"], 0.99)
    return a.withColumnRenamed("value", "p95").join(b.withColumnRenamed("value", "p99"), "path").select("path", F.round("p95", 9).alias("p95"), F.round("p99", 9).alias("p99"))


def slo_error_ratio(spark, d):
    return slo.error_ratio(fixtures.metrics(spark, d)).select(_ntz("bucket_ts"), "error_ratio")


def budget_remaining(spark, d):
    return slo.budget_remaining(fixtures.metrics(spark, d)).select(F.round("remaining", 9).alias("remaining"))


def burn_alerts(spark, d):
    hours = slo.error_ratio(fixtures.metrics(spark, d))
    fast = slo.firing(hours, F.col("error_ratio") > 0.02, 2, "fast_burn")
    slow = slo.firing(hours, F.col("error_ratio") > 0.005, 3, "slow_burn")
    return fast.unionByName(slow).withColumn("bucket_ts", F.col("bucket_ts").cast("timestamp_ntz"))


def request_rate(spark, d):
    return slo.rate(fixtures.metrics(spark, d), "1 hour").select(_ntz("bucket_ts"), "method", "path", "per_second")


def status_increase(spark, d):
    return slo.by_status(fixtures.metrics(spark, d), "1 hour").withColumn("bucket_ts", F.col("bucket_ts").cast("timestamp_ntz"))


def bench_summary(spark, d):
    return slo.summary(fixtures.events(spark, d).select(F.col("event_type").alias("metric"), "value"))


def protobuf_round_trip(spark, d):
    """Events that don't come back the same from the wire format; none."""
    from driftline.functions import codec
    e = fixtures.events(spark, d)
    wire = codec.encode_events(F.col("event_id").cast("string"), "tenant_id", "event_type", "payload", "value", F.unix_micros("occurred_at"))
    back = e.withColumn("d", codec.decode_events(wire))
    same = ((F.col("d.id") == F.col("event_id").cast("string")) & (F.col("d.tenant_id") == F.col("tenant_id")) & (F.col("d.value") == F.col("value"))
            & (F.col("d.payload") == F.col("payload")) & (S.from_nanos(F.col("d.occurred_ns")) == F.col("occurred_at")) & F.col("d.error").isNull())
    return back.where(~F.coalesce(same, F.lit(False))).select("event_id")


def scalar_functions(spark, d):
    e = fixtures.events(spark, d)
    t = F.col("tenant_id")
    return e.select("event_id", S.stream_name(t).alias("stream"), S.month_partition("occurred_at").alias("month"), S.rfc3339("occurred_at").alias("rfc"),
                    S.backoff_ms(F.col("event_id") % 6 + 1, 100, 1000).alias("backoff"), S.retry_after(F.col("value") / 10).cast("long").alias("retry_s"),
                    S.default_payload(F.when(F.col("event_id") % 2 == 0, F.col("payload")).otherwise(F.lit(""))).alias("payload"),
                    S.fingerprint(F.lit("GET"), F.lit("/x"), F.col("payload")).alias("print"), S.contains_pii("payload").alias("pii"),
                    S.is_masked("payload").alias("masked"), S.truncate_to("occurred_at", 37).cast("timestamp_ntz").alias("bucket_37s"))


QUERIES = {f.__name__: f for f in (
    daily_rollup_all, daily_rollup_range, daily_rollup_final, rollup_fingerprint, rollup_checksum, olap_daily_stats, rowstore_daily_stats, dedup_final,
    running_totals, daily_event_counts, incremental_totals, watermark_trace, window_1m_ontime, window_1h_ontime, window_7d_ontime, late_bucket_1m, late_bucket_1h,
    window_closed, window_stats_history, window_idempotent, live_snapshot, recent_events, search_payload, point_lookup, read_stream, cursor_scan, head_position,
    projection_lag, log_positions_all, shard_index, shard_distribution, shard_tenants, top_tenants, tenant_lookup_join, insert_ignore, erase_tenant, anonymise_docs,
    anonymise_log, pii_scan, pii_category_counts, export_tenant, consent_state, consent_gate, fencing_accept, fencing_per_tenant, skew_clamp, ingest_validate,
    batch_status, outbox_pending, credit_balance, charge_fold, idempotency_first, token_bucket, breaker_transitions, ryow_route, slo_histogram,
    slo_latency_quantile, slo_error_ratio, budget_remaining, burn_alerts, request_rate, status_increase, bench_summary, protobuf_round_trip, scalar_functions)}

_E = "(SELECT event_id, cast(user_id as varchar) AS tenant_id, event_type, props AS payload, value, ts AS occurred_at FROM events)"
_R = f"(SELECT * FROM {_E} UNION ALL SELECT * FROM {_E} WHERE event_id % 10 = 0)"
_T = """(SELECT cast(c_custkey as varchar) AS id, c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'free'
         WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 'pro' ELSE 'enterprise' END AS plan FROM customer)"""
_L = "(SELECT o_orderkey AS id, cast(o_custkey as varchar) AS tenant_id, cast(round(o_totalprice * 100) as bigint) AS amount_cents, o_orderdate AS created_at, o_orderstatus = 'O' AS pending FROM orders)"
_V = "coalesce(cast(sum(cast(value as decimal(28,4))) as double), 0)"
_A = f"(SELECT *, occurred_at + to_seconds((event_id * 7919) % 7200) AS arr FROM {_E})"
_M = f"(SELECT *, occurred_at < watermark - INTERVAL 30 SECOND AS is_late FROM (SELECT *, max(occurred_at) OVER (ORDER BY arr, event_id ROWS UNBOUNDED PRECEDING) AS watermark FROM {_A}))"
_AR = f"(SELECT *, event_id AS delivery_id FROM {_A} UNION ALL SELECT *, event_id + 1000000000 FROM {_A} WHERE event_id % 10 = 0)"
_MR = f"(SELECT *, occurred_at < watermark - INTERVAL 30 SECOND AS is_late FROM (SELECT *, max(occurred_at) OVER (ORDER BY arr, delivery_id ROWS UNBOUNDED PRECEDING) AS watermark FROM {_AR}))"
_MET = "(SELECT ts, 'GET' AS method, event_type AS path, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value / 1000 AS duration FROM events)"
_ROLL = f"SELECT tenant_id, event_type, cast(occurred_at as date) AS date, count(*) AS event_count, {_V} AS total_value FROM {_E}"
_MASKED = "text"
for _p in S.CATEGORIES.values():
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{S.REDACTED}', 'g')"
_CONSENT = f"""(SELECT tenant_id, CASE WHEN arg_max(event_type, event_id) = 'signup' THEN 1 ELSE 2 END AS state FROM
    (SELECT *, min(event_id) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY tenant_id) AS first FROM {_E} WHERE event_type IN ('signup', 'error'))
    WHERE event_id >= first GROUP BY 1)"""
_HIST = " UNION ALL ".join([f"SELECT path, {b} AS le, count(*) FILTER (WHERE duration <= {b}) AS n FROM {_MET} GROUP BY path" for b in slo.HTTP_BUCKETS]
                           + [f"SELECT path, cast('inf' as double) AS le, count(*) AS n FROM {_MET} GROUP BY path"])


def _window(seconds: int, source: str = _M) -> str:
    shift = (-62135596800) % seconds
    start = f"to_timestamp(epoch_us(occurred_at) // 1000000 - ((epoch_us(occurred_at) // 1000000 - {shift}) % {seconds})) AT TIME ZONE 'UTC'"
    return f"SELECT tenant_id, event_type, {start} AS window_start, count(*) AS event_count, {_V} AS sum_value FROM {source} WHERE NOT is_late GROUP BY ALL"


def _late(label: str) -> str:
    return f"SELECT tenant_id, event_type, '{label}' AS window_duration, count(*) AS event_count, {_V} AS sum_value FROM {_M} WHERE is_late GROUP BY ALL"


def _quantile(q: float) -> str:
    return f"""SELECT path, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (({q} * total - below) / (n - below)) END AS v FROM (
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY le) AS k FROM (
            SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY path) AS total
            FROM ({_HIST}) WINDOW w AS (PARTITION BY path ORDER BY le))
        WHERE {q} * total <= n AND ({q} * total > below OR below = 0 AND n > 0)) WHERE k = 1"""


def _firing(alert: str, limit: float, held: int) -> str:
    return f"""SELECT '{alert}' AS alert, bucket_ts, count(*) FILTER (WHERE r > {limit}) OVER (ORDER BY bucket_ts RANGE BETWEEN INTERVAL {held - 1} HOUR PRECEDING AND CURRENT ROW) = {held} AS firing
        FROM (SELECT date_trunc('hour', ts) AS bucket_ts, count(*) FILTER (WHERE status LIKE '5%') / count(*) AS r FROM {_MET} GROUP BY 1)"""


_TENANT_DAYS = f"SELECT cast(occurred_at as date) AS date, event_type, count(*) AS event_count, {_V} AS total_value FROM {{}} WHERE tenant_id = '{TENANT}' AND occurred_at >= '{FIRST}' AND occurred_at < '{LAST}' GROUP BY ALL"
ORACLE = {
    "daily_rollup_all": f"{_ROLL} GROUP BY ALL",
    "daily_rollup_range": f"{_ROLL} WHERE occurred_at >= '2024-01-05' AND occurred_at < '2024-01-12' GROUP BY ALL",
    "daily_rollup_final": f"SELECT tenant_id, event_type, date, event_count, total_value + 1.0 AS total_value FROM ({_ROLL} GROUP BY ALL)",
    "rollup_fingerprint": f"SELECT tenant_id, event_type, cast(occurred_at as date) AS date FROM {_E} WHERE false",
    "olap_daily_stats": _TENANT_DAYS.format(f"(SELECT DISTINCT * FROM {_R})"),
    "rowstore_daily_stats": _TENANT_DAYS.format(_R),
    "dedup_final": f"SELECT tenant_id, event_id, occurred_at, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, occurred_at, event_id ORDER BY event_id) AS k FROM {_R}) WHERE k = 1",
    "running_totals": f"SELECT tenant_id, event_type, count(*) AS event_count, {_V} AS total_value FROM {_E} GROUP BY ALL",
    "incremental_totals": f"SELECT tenant_id, event_type, count(*) AS event_count, {_V} AS total_value FROM {_E} GROUP BY ALL",
    "daily_event_counts": f"SELECT tenant_id, cast(occurred_at as date) AS event_date, event_type, count(*) AS event_count, {_V} AS total_value FROM {_E} GROUP BY ALL",
    "watermark_trace": f"SELECT event_id, watermark, is_late FROM {_M}",
    "window_1m_ontime": _window(60), "window_1h_ontime": _window(3600), "window_7d_ontime": _window(7 * 86400),
    "late_bucket_1m": _late("1m"), "late_bucket_1h": _late("1h"),
    "window_closed": f"SELECT DISTINCT date_trunc('hour', occurred_at) AS window_start, (SELECT max(watermark) FROM {_M}) >= date_trunc('hour', occurred_at) + INTERVAL 3630 SECOND AS is_closed FROM {_M} WHERE NOT is_late",
    "window_stats_history": f"""SELECT tenant_id, event_type, '1h' AS window_duration, window_start, event_count, sum_value, false AS is_late FROM ({_window(3600)})
        WHERE (SELECT max(watermark) FROM {_M}) >= window_start + INTERVAL 3630 SECOND
        UNION ALL SELECT tenant_id, event_type, window_duration, NULL, event_count, sum_value, true FROM ({_late('1h')})""",
    "window_idempotent": _window(3600, f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, event_type, CASE WHEN NOT is_late THEN date_trunc('hour', occurred_at) END, event_id
        ORDER BY arr, delivery_id) AS k FROM {_MR}) WHERE k = 1)"""),
    "live_snapshot": f"""SELECT tenant_id, event_type, window_start, coalesce(event_count, 0) AS event_count, coalesce(sum_value, 0) AS sum_value
        FROM (SELECT DISTINCT tenant_id, event_type, (SELECT date_trunc('hour', max(watermark)) FROM {_M}) AS window_start FROM {_E}) k LEFT JOIN ({_window(3600)}) USING (tenant_id, event_type, window_start)""",
    "recent_events": f"SELECT event_id AS id, event_type, value, occurred_at FROM {_E} ORDER BY occurred_at DESC, event_id LIMIT 100",
    "search_payload": f"""SELECT event_id AS id, event_type, payload, occurred_at FROM {_E} WHERE payload ILIKE '%"k": 9%'""",
    "point_lookup": f"SELECT * FROM {_T} WHERE id = '{TENANT}'",
    "read_stream": f"SELECT event_id + 1 AS stream_position, 'EventIngested' AS event_type, occurred_at FROM {_E} WHERE tenant_id = '{TENANT}'",
    "cursor_scan": f"SELECT event_id + 1 AS stream_position, 'tenant-' || tenant_id AS stream_name FROM {_E} WHERE event_id + 1 > 500 ORDER BY 1 LIMIT 1000",
    "head_position": f"SELECT coalesce(max(event_id + 1), 0) AS head FROM {_E}",
    "projection_lag": f"""SELECT projection, last_position, h AS head_position, greatest(0, h - last_position) AS lag FROM (SELECT * FROM (VALUES ('tenant_stats', 90::bigint), ('daily_event_counts', 50), ('ahead', 10000000)) v(projection, last_position)),
        (SELECT max(event_id + 1) AS h FROM {_E})""",
    "log_positions_all": f"SELECT event_id, 1000 + row_number() OVER (ORDER BY occurred_at, event_id) AS stream_position FROM {_E}",
    "shard_index": f"SELECT DISTINCT tenant_id, cast(('0x' || substr(sha256(tenant_id), 1, 16))::ubigint % 4 as int) AS shard FROM {_E}",
    "shard_distribution": f"""SELECT cast(s.range as int) AS shard, coalesce(tenants, 0) AS tenants, coalesce(events, 0) AS events, last_event FROM range(4) s LEFT JOIN
        (SELECT ('0x' || substr(sha256(tenant_id), 1, 16))::ubigint % 4 AS k, count(DISTINCT tenant_id) AS tenants, count(*) AS events, max(occurred_at) AS last_event FROM {_E} GROUP BY 1) ON k = s.range""",
    "shard_tenants": f"SELECT cast(('0x' || substr(sha256(tenant_id), 1, 16))::ubigint % 4 as int) AS shard, count(DISTINCT tenant_id) AS tenant_count FROM {_E} GROUP BY 1",
    "top_tenants": f"SELECT tenant_id, cast(('0x' || substr(sha256(tenant_id), 1, 16))::ubigint % 4 as int) AS shard, count(*) AS events FROM {_E} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20",
    "tenant_lookup_join": f"""SELECT 'key-' || id AS key_id, id AS tenant_id, 'tenant' AS scope, plan FROM {_T} WHERE cast(id as bigint) % 7 <> 0
        UNION ALL SELECT 'key-admin', NULL, 'admin', NULL""",
    "insert_ignore": f"SELECT id AS tenant_id, cast(CASE WHEN cast(id as bigint) % 2 = 0 THEN 5 ELSE 0 END as bigint) AS balance_cents FROM {_T}",
    "erase_tenant": f"""SELECT 'tenants' AS table_name, count(*) AS remaining FROM {_T} WHERE id <> '{TENANT}' UNION ALL SELECT 'events', count(*) FROM {_E} WHERE tenant_id <> '{TENANT}'
        UNION ALL SELECT 'event_log', count(*) FROM {_E} WHERE tenant_id <> '{TENANT}'
        UNION ALL SELECT 'tenant_event_counts', count(DISTINCT (tenant_id, event_type)) FROM {_E} WHERE tenant_id <> '{TENANT}'
        UNION ALL SELECT 'daily_event_counts', count(DISTINCT (tenant_id, cast(occurred_at as date), event_type)) FROM {_E} WHERE tenant_id <> '{TENANT}'
        UNION ALL SELECT 'billing_records', count(*) FROM {_L} WHERE tenant_id <> '{TENANT}'""",
    "anonymise_docs": f"SELECT doc_id, {_MASKED} AS text, text IS NOT NULL AND {_MASKED} <> text AS changed FROM documents",
    "anonymise_log": f"""SELECT count(*) AS scanned, count(*) FILTER (WHERE payload LIKE '{{"k": 9%') AS anonymised FROM {_E} WHERE tenant_id = '{TENANT}'""",
    "pii_scan": "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{p}'), false) AS has_{'ip' if k == 'ip_address' else k}" for k, p in S.CATEGORIES.items()) + " FROM documents",
    "pii_category_counts": " UNION ALL ".join(f"SELECT '{k}' AS category, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS n FROM documents" for k, p in S.CATEGORIES.items()),
    "export_tenant": f"SELECT tenant_id, count(*) AS n_events, min(occurred_at) AS first_ts, max(occurred_at) AS last_ts FROM {_E} WHERE tenant_id = '{TENANT}' GROUP BY 1",
    "consent_state": f"SELECT DISTINCT tenant_id, 'analytics' AS purpose, coalesce(state, 0) AS state FROM {_E} LEFT JOIN {_CONSENT} USING (tenant_id)",
    "consent_gate": f"SELECT tenant_id, count(*) AS event_count FROM {_E} LEFT JOIN {_CONSENT} USING (tenant_id) WHERE coalesce(state, 0) <> 2 GROUP BY 1",
    "fencing_accept": "SELECT event_id, token, token > coalesce(max(token) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM (SELECT event_id, (event_id * 7919) % 1000 + 1 AS token FROM events)",
    "fencing_per_tenant": "SELECT event_id, token, token > coalesce(max(token) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS accepted FROM (SELECT event_id, user_id, (event_id * 7919) % 1000 + 1 AS token FROM events)",
    "skew_clamp": f"SELECT event_id, CASE WHEN TIMESTAMP '{NOW}' - occurred_at > INTERVAL '-1 hour' AND TIMESTAMP '{NOW}' - occurred_at < INTERVAL 24 HOUR THEN occurred_at ELSE TIMESTAMP '{NOW}' END AS occurred_at FROM {_E}",
    "ingest_validate": "SELECT event_id, cast(CASE WHEN event_id % 50 = 0 THEN 400 ELSE 201 END as int) AS status, CASE WHEN event_id % 50 = 0 THEN 'EVENT_TYPE_REQUIRED' END AS code FROM events",
    "batch_status": "SELECT count(*) AS accepted, count(*) FILTER (WHERE event_id % 50 <> 0) AS ok, cast(CASE WHEN count(*) FILTER (WHERE event_id % 50 = 0) > 0 THEN 207 ELSE 201 END as int) AS status FROM events",
    "outbox_pending": f"SELECT id, tenant_id, amount_cents, created_at FROM {_L} WHERE pending ORDER BY created_at, id LIMIT 100",
    "credit_balance": f"SELECT t.id AS tenant_id, cast(coalesce(sum(amount_cents), 0) as bigint) AS balance_cents FROM {_T} t LEFT JOIN {_L} l ON l.tenant_id = t.id GROUP BY 1",
    "idempotency_first": f"""SELECT ns_key, seq, winner_id, CASE WHEN seq = winner_id THEN 'reserved' WHEN payload = first THEN 'replay' ELSE 'reused' END AS outcome FROM
        (SELECT 't:' || tenant_id || ':' || event_type AS ns_key, event_id AS seq, payload, first_value(event_id) OVER w AS winner_id, first_value(payload) OVER w AS first
         FROM {_E} WINDOW w AS (PARTITION BY tenant_id, event_type ORDER BY event_id))""",
    "ryow_route": """SELECT event_id, req AS required_lsn, replay >= req AS to_replica, CASE WHEN ahead = 0 THEN 'caught_up' WHEN ahead < 1048576 THEN 'healthy' WHEN ahead < 10485760 THEN 'lagging' ELSE 'critical' END AS lag_status
        FROM (SELECT event_id, coalesce(nullif((event_id * 37) % 600 * (event_id % 2), 0), 500) AS req, (event_id * 91) % 1000 AS replay, event_id * 4096 % 20000000 AS ahead FROM events)""",
    "slo_histogram": _HIST,
    "slo_latency_quantile": f"SELECT a.path, round(a.v, 9) AS p95, round(b.v, 9) AS p99 FROM ({_quantile(0.95)}) a JOIN ({_quantile(0.99)}) b USING (path)",
    "slo_error_ratio": f"SELECT date_trunc('hour', ts) AS bucket_ts, count(*) FILTER (WHERE status LIKE '5%') / count(*) AS error_ratio FROM {_MET} GROUP BY 1",
    "budget_remaining": f"SELECT round(1.0::double - (count(*) FILTER (WHERE status LIKE '5%') / count(*)) / 0.005::double, 9) AS remaining FROM {_MET}",
    "burn_alerts": f"{_firing('fast_burn', 0.02, 2)} UNION ALL {_firing('slow_burn', 0.005, 3)}",
    "request_rate": f"SELECT date_trunc('hour', ts) AS bucket_ts, method, path, count(*) / 3600 AS per_second FROM {_MET} GROUP BY ALL",
    "status_increase": f"SELECT date_trunc('hour', ts) AS bucket_ts, status, count(*) AS increase FROM {_MET} GROUP BY ALL",
    "bench_summary": "SELECT event_type AS metric, min(value) AS min, list_sort(list(value))[count(*) // 2 + 1] AS median, max(value) AS max FROM events GROUP BY 1",
    "protobuf_round_trip": "SELECT event_id FROM events WHERE false",
    "scalar_functions": f"""SELECT event_id, 'tenant-' || tenant_id AS stream, strftime(occurred_at, '%Y%m') AS month, strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ') AS rfc,
        cast(least(1000, 100 * pow(2, event_id % 6)) as bigint) AS backoff, cast(greatest(ceil(value / 10), 1) as bigint) AS retry_s, CASE WHEN event_id % 2 = 0 THEN payload ELSE '{{}}' END AS payload,
        sha256('GET' || chr(10) || '/x' || chr(10) || payload) AS print, false AS pii, false AS masked,
        to_timestamp(epoch_us(occurred_at) // 1000000 - ((epoch_us(occurred_at) // 1000000 - {(-62135596800) % 37}) % 37)) AT TIME ZONE 'UTC' AS bucket_37s FROM {_E}""",
}


def stream_window_1h(spark, d):
    """The hour windows reached by streaming the arrivals in four files, batch by batch."""
    from driftline import scratch
    from driftline.streaming import windows as streaming
    root = scratch.new_path(spark, "stream")
    a = fixtures.arrivals(spark, d)
    cuts = a.agg(F.percentile_approx(F.unix_micros("received_at"), [0.25, 0.5, 0.75]).alias("c")).first()["c"]
    us = F.unix_micros("received_at")
    part = F.when(us <= cuts[0], 0).when(us <= cuts[1], 1).when(us <= cuts[2], 2).otherwise(3)
    for i in range(4):
        a.where(part == i).coalesce(1).write.parquet(f"{root}/in/{i}")
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    ws = streaming.run(spark, stream, f"{root}/out", (3600,))
    return ws.state(3600).where("NOT is_late").select("tenant_id", "event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_count", "sum_value")


QUERIES["stream_window_1h"] = stream_window_1h
ORACLE["stream_window_1h"] = _window(3600)
