"""Queries of sinks, state machines, catalogs and service levels, with the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions import codec
from driftline.functions import scalar as S
from driftline.operators import final, ingest, keys, ledger, machines, masking, privacy, projections, rollup, search, shard, slo
from driftline.plans.reference import _E, _HIST, _L, _M, _MASKED, _R, _ROLL, _T, _V, FIRST, LAST, NOW, TENANT, _late, _ntz, _window
from driftline.sources import event_log, fixtures, topic
from driftline.sources.tables import read
from driftline.streaming import consumer, windows
from driftline.streaming import projections as followed

WEEK = (dt.date(2024, 1, 5), dt.date(2024, 1, 12))
DAY = dt.date(2024, 1, 9)


def _at(second: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(second, dt.timezone.utc)


def rollup_rerun(spark, d):
    """A week's rollup written, and written again with values one greater; the later rows win."""
    e, path = fixtures.events(spark, d), scratch.new_path(spark, "rollup")
    rollup.run(e, path, *WEEK, _at(1))
    rollup.run(e.withColumn("value", F.col("value") + 1), path, *WEEK, _at(2))
    return final.final_rollup(spark.read.parquet(path)).select("tenant_id", "event_type", "date", "event_count", "total_value")


def rollup_repaired(spark, d):
    """The week's rollup with a day repaired after its views were gone."""
    e, path = fixtures.events(spark, d), scratch.new_path(spark, "rollup")
    rollup.run(e, path, *WEEK, _at(1))
    rollup.repair(e.where("event_type <> 'view'"), path, DAY, _at(2))
    return final.final_rollup(spark.read.parquet(path)).select("tenant_id", "event_type", "date", "event_count", "total_value")


def rollup_differences(spark, d):
    """Rows in which source and sink differ: the sink holds errors one too high, no signups, and a type of its own."""
    e = fixtures.events(spark, d)
    run = rollup.daily(e).where("event_type <> 'signup'")
    run = run.withColumn("total_value", F.col("total_value") + F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    own = run.where("event_type = 'click'").withColumn("event_type", F.lit("tap"))
    return rollup.differences(e, run.unionByName(own).withColumn("inserted_at", F.timestamp_seconds(F.lit(1))))


def rollup_checksum_day(spark, d):
    """The checksums of a day's rollup over all tenants, of a rerun of it, and of one with another value."""
    day = rollup.daily(fixtures.events(spark, d), DAY, DAY + dt.timedelta(days=1))
    other = day.withColumn("event_count", F.col("event_count") + 1)
    return spark.createDataFrame([(rollup.checksum(day), rollup.checksum(day.orderBy(F.desc("total_value"))), rollup.checksum(other))], "source string, rerun string, other string")


def olap_newest_days(spark, d):
    return rollup.tenant_days(fixtures.redelivered(fixtures.events(spark, d)), TENANT, FIRST, LAST, limit=20)


def olap_ranges(spark, d):
    """The ranges that requests for daily statistics come to, on the middle of the month."""
    today, asked = dt.date(2024, 1, 15), [(None, None), ("2024-01-05", None), (None, "2024-01-20"), ("2023-02-01", "2024-01-31")]
    return spark.createDataFrame([(i, *rollup.olap_range(a, b, today)) for i, (a, b) in enumerate(asked)], "request int, first date, last date")


def final_subsecond(spark, d):
    """Copies that differ below the second and in their value are one event: the last."""
    e = fixtures.events(spark, d)
    copy = e.where("event_id % 10 = 0").withColumn("occurred_at", F.date_trunc("second", "occurred_at") + F.expr("INTERVAL 999 MILLISECONDS")).withColumn("value", -F.col("value"))
    return final.final_events(e.unionByName(copy)).select("tenant_id", "event_id", _ntz("occurred_at"), "event_type", "value")


def tenants_newest(spark, d):
    return search.newest(read(spark, d, "tenants"), "created_at", "id").select("id", "name", _ntz("created_at"))


def audit_newest(spark, d):
    """One tenant's audit entries of a resource type, newest first, a limit out of range taking the default."""
    audit = search.where_all(read(spark, d, "audit_log"), [F.col("resource_id").isNotNull(), None, F.col("tenant_id").isNotNull()])
    return search.newest(audit, "occurred_at", "id", 5000).select("id", "tenant_id", "action", _ntz("occurred_at"))


def pii_scan_counts(spark, d):
    """What a scan of the newest deliveries for personal data reports."""
    return masking.scan_counts(read(spark, d, "usage_events"), since=dt.datetime(2000, 1, 1), tie="delivery_id")


def masked_documents(spark, d):
    """Which documents hold a placeholder after masking."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.coalesce(S.is_masked(S.mask_pii("text")), F.lit(False)).alias("masked"))


def tenants_active(spark, d):
    """Tenants with any delivery."""
    return final.with_any(read(spark, d, "tenants"), read(spark, d, "usage_events").select(F.col("tenant_id").alias("id")), ["id"]).select("id", "plan")


def idempotency_expired(spark, d):
    e = fixtures.events(spark, d)
    kept = e.select("event_id", F.when(F.col("event_id") % 3 == 0, "in_flight").otherwise("completed").alias("state"), F.col("occurred_at").alias("created_at"))
    return machines.expired(kept, NOW).select("event_id", "state")


def idempotency_outcomes(spark, d):
    """Requests under their tenant's and type's key: of an hour and a half each, every fourth failing, every third with another body."""
    e = fixtures.events(spark, d)
    at = F.unix_micros("occurred_at") / 1e6
    asked = e.select(F.concat(F.lit("t:"), "tenant_id", F.lit(":"), "event_type").alias("ns_key"), at.alias("at_s"), (F.col("event_id") % 3 == 0).cast("string").alias("fingerprint"),
                     (at + 5400.0).alias("done_s"), F.when(F.col("event_id") % 4 == 0, 500).otherwise(201).alias("code"))
    return machines.idempotency(asked, in_flight_for=7200.0)


def projection_kinds(spark, d):
    """Running totals of a log that holds other kinds too; these only move the position."""
    log = fixtures.log(spark, d).withColumn("event_type", F.when(F.col("stream_position") % 4 == 0, "TenantRenamed").otherwise(F.col("event_type")))
    log = log.withColumn("data", F.when(F.col("event_type") == "TenantRenamed", '{"name": "x"}').otherwise(F.col("data")))
    root, p = scratch.new_path(spark, "projection"), projections.RunningTotals()
    reached = p.catch_up(log, root)
    return p.state(spark, root).withColumn("position", F.lit(reached).cast("long"))


def projection_rebuilt(spark, d):
    """Daily counts rebuilt from the whole log after a catch-up over half of it."""
    log, root, p = fixtures.log(spark, d), scratch.new_path(spark, "projection"), projections.DailyCounts()
    p.catch_up(log, root, head=event_log.head(log) // 2)
    p.rebuild(log, root)
    return p.state(spark, root)


def _minted(spark, d):
    t = fixtures.tenants(spark, d)
    new = t.select(F.concat(F.lit("key-"), "id").alias("id"), F.col("id").alias("tenant_id"), F.lit("tenant").alias("scope"), F.concat(F.lit("live_"), F.sha2("id", 256)).alias("secret"))
    admin = spark.range(1).select(F.lit("key-admin").alias("id"), F.lit(None).cast("string").alias("tenant_id"), F.lit("admin").alias("scope"), F.lit("live_admin").alias("secret"))
    return keys.mint(new.unionByName(admin))


def api_keys(spark, d):
    """Keys as stored: hash and prefix of the secret; minting them again adds none."""
    minted = _minted(spark, d)
    return keys.ensure(_minted(spark, d), minted).select("id", "tenant_id", "scope", "prefix", F.lower(F.hex("key_hash")).alias("key_hash"))


def key_touched(spark, d):
    """A key's last use moves if it is unset or five minutes old; another's doesn't."""
    used = fixtures.events(spark, d).select(F.lit("key-1").alias("id"), "event_id", F.when(F.col("event_id") % 5 > 0, F.col("occurred_at")).alias("last_used_at"))
    used = used.unionByName(used.withColumn("id", F.lit("key-2")))
    return keys.touch(used, "key-1", NOW).select("id", "event_id", _ntz("last_used_at"))


def key_revoked(spark, d):
    twice = keys.revoke(keys.revoke(_minted(spark, d), "key-3", _at(100)), "key-3", _at(200))
    return twice.select("id", _ntz("revoked_at"))


def key_permitted(spark, d):
    """Requests that their key may make: its own tenant's, or any for the admin's."""
    e = fixtures.events(spark, d)
    other = F.when(F.col("event_id") % 3 == 0, F.lit("1")).otherwise(F.col("tenant_id"))
    asked = e.select("event_id", F.when(F.col("event_id") % 7 == 0, "key-admin").otherwise(F.concat(F.lit("key-"), "tenant_id")).alias("key_id"), other.alias("tenant_id"))
    return keys.permitted(asked, _minted(spark, d)).select("event_id", "key_id", "tenant_id")


def shard_read(spark, d):
    """A tenant's events from sharded storage, of which only its shard's partitions are read."""
    path = scratch.new_path(spark, "shards")
    shard.write(fixtures.events(spark, d), path)
    return shard.read_tenant(spark, path, TENANT).select("event_id", "event_type", "value", "shard", F.col("month").cast("string").alias("month"))


def window_keys(spark, d):
    """Keys of window state taken apart; malformed ones are null."""
    e = fixtures.events(spark, d)
    end = F.when(F.col("event_id") % 5 == 0, "late").when(F.col("event_id") % 5 == 1, "not-a-time").otherwise(F.unix_seconds("occurred_at").cast("string"))
    head = F.when(F.col("event_id") % 5 == 2, "windows").otherwise("window")
    got = e.select("event_id", S.parse_window_key(F.concat_ws(":", head, F.lit("1m"), "tenant_id", "event_type", end)).alias("k"))
    return got.select("event_id", "k.duration", "k.tenant_id", "k.event_type", F.col("k.window_start").cast("timestamp_ntz").alias("window_start"), "k.is_late")


def scalar_conversions(spark, d):
    """Conversions of times, numbers and texts."""
    e = fixtures.events(spark, d)
    micros, ms = F.unix_micros("occurred_at"), F.unix_millis("occurred_at")
    digit = lambda i: F.substring(F.lit(S.CROCKFORD), (F.shiftright(ms, 5 * i).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1))
    merged = S.merge_maps(F.create_map(F.lit("a"), F.lit("envelope"), F.lit("b"), F.lit("envelope"), F.lit("c"), F.lit("envelope")),
                          F.create_map(F.lit("b"), F.lit("super"), F.lit("c"), F.lit("super")), F.create_map(F.lit("c"), "event_type"))
    return e.select("event_id", F.unix_seconds("occurred_at").alias("unix_s"), S.from_nanos(micros * 1000 + F.col("event_id") % 1000).cast("timestamp_ntz").alias("of_nanos"),
                    S.ulid_time(F.concat(*[digit(i) for i in range(9, -1, -1)], F.lit("0" * 16))).cast("timestamp_ntz").alias("of_ulid"), codec.float_text("value").alias("value_text"),
                    codec.float_text((F.col("event_id") + 1) * 1e9).alias("large_text"), S.shard_name("main", F.col("event_id") % 4).alias("database"),
                    S.url_safe_secret(F.unhex(F.sha2("tenant_id", 256))).alias("secret"), S.times_faster("value", F.col("event_id") % 50 + 1.0).alias("times"),
                    S.faster_label("value", F.col("event_id") % 50 + 1.0).alias("label"), merged["a"].alias("merged_a"), merged["b"].alias("merged_b"), merged["c"].alias("merged_c"))


def protobuf_decoded(spark, d):
    """The fields of events read back from the wire format."""
    e = fixtures.events(spark, d)
    wire = codec.encode_events(F.col("event_id").cast("string"), "tenant_id", "event_type", "payload", "value", F.unix_micros("occurred_at"))
    return e.select("event_id", codec.decode_events(wire).alias("d")).select("event_id", "d.id", "d.tenant_id", "d.event_type", "d.payload", "d.value", "d.occurred_ns", "d.error")


def protobuf_broken(spark, d):
    """Messages cut short don't decode; unknown fields after them are skipped."""
    e = fixtures.events(spark, d)
    wire = codec.encode_events(F.col("event_id").cast("string"), "tenant_id", "event_type", "payload", "value", F.unix_micros("occurred_at"))
    cut = F.when(F.col("event_id") % 2 == 0, F.substring("w", 1, 2)).otherwise(F.concat(F.col("w"), F.unhex(F.lit("4d0000803f"))))
    return e.select("event_id", wire.alias("w")).select("event_id", codec.decode_events(cut).alias("d")).select("event_id", F.col("d.error").isNotNull().alias("broken"), "d.tenant_id")


def ingest_rows(spark, d):
    """A batch's answer row by row."""
    first = fixtures.events(spark, d).orderBy("event_id").limit(ingest.BATCH_ROWS)  # the most rows a batch may have
    rows = first.withColumn("event_type", F.when(F.col("event_id") % 50 != 0, F.col("event_type")))
    return ingest.row_results(ingest.validate(rows), "event_id").select(F.col("index").cast("long").alias("index"), "id", "status", "code", "error")


def dual_written(spark, d):
    """Rows of the log and of events after a batch was written, and sent again after it had failed between the two."""
    e, log, events = fixtures.events(spark, d), scratch.new_path(spark, "log"), scratch.new_path(spark, "events")
    event_log.append(e, log, batch="b1")  # as far as the first attempt came
    for _ in range(2):
        ingest.dual_write(e, log, events, "b1")
    a = event_log.read(spark, log).groupBy(F.expr("substring(stream_name, 8)").alias("tenant_id")).agg(F.count("*").alias("logged"), F.max("stream_position").alias("last"))
    b = spark.read.parquet(events).groupBy("tenant_id").agg(F.count("*").alias("stored"))
    return a.join(b, "tenant_id")


def outbox_swept(spark, d):
    """Ledger rows after a sweep of the outbox in which some could not be sent."""
    records = fixtures.ledger(spark, d).withColumn("outbox_sent_at", F.when(~F.col("pending"), F.col("created_at")))
    after = ledger.publish(records, lambda rows: rows.where("id % 7 <> 0"), NOW)
    return after.select("id", _ntz("outbox_sent_at"))


def export_parts(spark, d):
    """The parts of a tenant's portability document."""
    consents = fixtures.events(spark, d).where("event_type = 'signup'").select("tenant_id", F.lit("analytics").alias("purpose")).distinct()
    lines = privacy.export(fixtures.tenants(spark, d), fixtures.events(spark, d), consents, TENANT)
    return lines.groupBy("part").agg(F.count("*").alias("lines"), _max_of("json", "event_id").alias("last_event"), _max_of("json", "plan").alias("plan"), _max_of("json", "purpose").alias("purpose"))


def _max_of(json: str, field: str):
    value = F.get_json_object(json, f"$.{field}")
    return F.max(value.cast("long") if field == "event_id" else value)


def erase_tenants(spark, d):
    """Events left after several tenants were erased."""
    gone = fixtures.tenants(spark, d).where("plan = 'free'")
    return privacy.erase_many(fixtures.events(spark, d), gone).groupBy("tenant_id").agg(F.count("*").alias("events"))


def _api(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.http(spark, d)


def slo_quantiles_5m(spark, d):
    got = slo.rolling_quantiles(_api(spark, d), ["method", "path"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return got.select(_ntz("bucket_ts"), "method", "path", *[F.round(c, 9).alias(c) for c in ("p50", "p95", "p99")])


def slo_worst_p99(spark, d):
    """The greatest 99th percentile of any path at each minute."""
    got = slo.rolling_quantiles(_api(spark, d), ["method", "path"], {"p99": 0.99})
    return got.groupBy(_ntz("bucket_ts")).agg(F.round(F.max("p99"), 9).alias("worst"))


def slo_rolling_ratios(spark, d):
    """Error ratios of 5 minutes, an hour and 6 hours, and what is left of the 7-day budget, at each minute."""
    m = scratch.table(slo.minutes(_api(spark, d)), "slo-evaluations")
    out = None
    for name, seconds in (("ratio_5m", 300), ("ratio_1h", 3600), ("ratio_6h", 6 * 3600), ("ratio_7d", 7 * 86400)):
        one = slo.rolling_error_ratio(m, seconds, name)
        out = one if out is None else out.join(one, "bucket_ts")
    left = F.lit(1.0) - F.col("ratio_7d") / F.lit(slo.BUDGET)
    return out.select(_ntz("bucket_ts"), *[F.round(c, 9).alias(c) for c in ("ratio_5m", "ratio_1h", "ratio_6h")], F.round(left, 9).alias("budget_left"))


def slo_alerts(spark, d):
    return slo.alerts(_api(spark, d)).withColumn("bucket_ts", F.col("bucket_ts").cast("timestamp_ntz"))


LIMITS = {"/api/v1/events": (990, 0.45), "/api/v1/tenants": (950, 0.2), "/api/v1/tenants/{id}": (500, 0.3)}


def load_thresholds(spark, d):
    return slo.thresholds(slo.requests(_api(spark, d)), LIMITS)


def metrics_exposition(spark, d):
    return slo.exposition(_api(spark, d))


def olap_histogram(spark, d):
    """Counts in the buckets of columnar queries."""
    return slo.histogram(fixtures.metrics(spark, d), ["path"], slo.OLAP_BUCKETS)


def _published(spark: SparkSession, d: str) -> str:
    """All events as messages of a topic, and two that can't be decoded."""
    path = scratch.new_path(spark, "topic")
    topic.publish(topic.messages(fixtures.events(spark, d), ["occurred_at", "event_id"]), path)
    topic.publish(spark.createDataFrame([(b"k", b"\x0a\x09x", {"a": "b"}), (b"k", b"\x0a", {"a": "b"})], "key binary, value binary, headers map<string,string>"), path)
    return path


def stream_topic(spark, d):
    """Events that went through a topic: published, consumed batch by batch, stored in columns."""
    path, out = _published(spark, d), scratch.new_path(spark, "consumed")
    consumer.consume(spark, path, lambda good, batch: good.write.mode("overwrite").parquet(f"{out}/batch={batch}"), f"{out}-checkpoint", files_per_trigger=4)
    return spark.read.parquet(out).select("event_id", "tenant_id", "event_type", "payload", "value", _ntz("occurred_at"))


def stream_dead_letters(spark, d):
    """Dead letters of a consumer whose handler fails for errors, and can't do anything about the others."""
    path, out = _published(spark, d), scratch.new_path(spark, "dead")

    def handler(events: DataFrame, batch) -> DataFrame:
        return events.where("event_type = 'error'").select("event_id", F.lit("not an event").alias("last_error"))

    consumer.consume(spark, path, handler, f"{out}-checkpoint", dlq=out, files_per_trigger=4)
    dead = spark.read.option("recursiveFileLookup", "true").parquet(out)
    tenants = F.count_distinct(F.when(F.col("reason") != "unmarshal_failed", F.decode("key", "utf-8")))
    return dead.groupBy("reason", F.col("attempts").cast("long").alias("attempts")).agg(F.count("*").alias("messages"), tenants.alias("tenants"),
                                                                                     F.count_distinct("original_partition", "original_offset").alias("places"))


def stream_projection(spark, d):
    """Daily counts that followed a log while it was appended to."""
    log, root, p = scratch.new_path(spark, "log"), scratch.new_path(spark, "followed"), projections.DailyCounts()
    e = fixtures.events(spark, d)
    middle = F.lit(NOW).cast("timestamp")
    for part in (e.where(F.col("occurred_at") < middle), e.where(F.col("occurred_at") >= middle)):
        event_log.append(part, log)
        followed.follow(spark, log, p, root)
    return p.state(spark, root)


def stream_history(spark, d):
    """Window history as flushed: swept after half of the arrivals and after all of them."""
    a, root = fixtures.arrivals(spark, d), scratch.new_path(spark, "windows")
    us = F.unix_micros("received_at")
    cut = a.agg(F.percentile_approx(us, 0.5).alias("c")).first()["c"]
    ws = windows.WindowStream(spark, root, (3600,))
    for i, part in enumerate((a.where(us <= cut), a.where(us > cut))):
        ws.process(part, i)
        ws.sweep(_at(1_800_000_000 + i))
    return ws.history().select("tenant_id", "event_type", "window_duration", _ntz("window_start"), "event_count", "sum_value", "is_late")


def stream_frames(spark, d):
    """Live frames of the hour that holds the watermark."""
    root = scratch.new_path(spark, "windows")
    ws = windows.WindowStream(spark, root, (3600,))
    ws.process(fixtures.arrivals(spark, d), 0)
    return ws.frames(3600, NOW).select("tenant_id", "event_type", "window_label", _ntz("window_start"), "event_count", "sum_value", "based_on", _ntz("watermark"))


QUERIES = {f.__name__: f for f in (
    stream_topic, stream_dead_letters, stream_projection, stream_history, stream_frames, rollup_rerun, rollup_repaired, rollup_differences, rollup_checksum_day, olap_newest_days, olap_ranges, final_subsecond, tenants_newest, audit_newest, pii_scan_counts,
    masked_documents, tenants_active, idempotency_expired, idempotency_outcomes, projection_kinds, projection_rebuilt, api_keys, key_touched, key_revoked, key_permitted, shard_read, window_keys,
    scalar_conversions, protobuf_decoded, protobuf_broken, ingest_rows, dual_written, outbox_swept, export_parts, erase_tenants, slo_quantiles_5m, slo_worst_p99, slo_rolling_ratios,
    slo_alerts, load_thresholds, metrics_exposition, olap_histogram)}

_WEEK = "occurred_at >= '2024-01-05' AND occurred_at < '2024-01-12'"
_PLAIN = r"regexp_replace(cast({} as varchar), '\.0$', '')"
_LINE = f"tenant_id || '|' || event_type || '|' || strftime(date, '%Y-%m-%d') || '|' || cast(event_count as varchar) || '|' || {_PLAIN.format('total_value')} || chr(10)"
_DAY_ROLL = f"({_ROLL} WHERE occurred_at >= '2024-01-09' AND occurred_at < '2024-01-10' GROUP BY ALL)"
_ROUTE = {i: " ".join(f"WHEN '{k}' THEN '{r[i]}'" for k, r in fixtures.ROUTES.items()) for i in (0, 1)}
_HTTP = f"""(SELECT ts, CASE WHEN event_id % 10 = 9 THEN 'GET' ELSE CASE event_type {_ROUTE[0]} END END AS method,
    CASE WHEN event_id % 10 = 9 THEN '/api/v1/metrics' ELSE CASE event_type {_ROUTE[1]} END END AS path,
    CASE WHEN event_type = 'error' AND event_id % 40 = 0 THEN '500' ELSE '200' END AS status, value / 200 AS duration FROM events)"""
_BOUNDS = ", ".join(f"({b}::double)" for b in slo.HTTP_BUCKETS) + ", (cast('inf' as double))"
_H5 = f"""(SELECT t, method, path, le, cast(sum(n) as bigint) AS n FROM (SELECT date_trunc('minute', ts) + to_minutes(cast(k AS bigint)) AS t, method, path, le, count(*) FILTER (WHERE duration <= le OR isinf(le)) AS n
    FROM {_HTTP}, range(5) r(k), (VALUES {_BOUNDS}) b(le) WHERE path <> '/api/v1/metrics' GROUP BY ALL) GROUP BY ALL)"""


def _q5(q: float) -> str:
    return f"""(SELECT t, method, path, CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (({q} * total - below) / (n - below)) END AS v FROM (
        SELECT *, row_number() OVER (PARTITION BY t, method, path ORDER BY le) AS k FROM (
            SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY t, method, path) AS total
            FROM {_H5} WINDOW w AS (PARTITION BY t, method, path ORDER BY le))
        WHERE {q} * total <= n AND ({q} * total > below OR below = 0 AND n > 0)) WHERE k = 1)"""


_MIN = f"(SELECT date_trunc('minute', ts) AS t, count(*) AS n, count(*) FILTER (WHERE status LIKE '5%') AS e FROM {_HTTP} WHERE path <> '/api/v1/metrics' GROUP BY 1)"
_GRID = f"(SELECT g.t, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 MINUTE)) AS t FROM {_MIN}) g LEFT JOIN {_MIN} m ON m.t = g.t)"


def _ratio(minutes: int) -> str:
    w = f"(ORDER BY t RANGE BETWEEN INTERVAL {minutes - 1} MINUTE PRECEDING AND CURRENT ROW)"
    return f"coalesce(sum(e) OVER {w} / nullif(sum(n) OVER {w}, 0), 0)"


def _held(alert: str, rows: str, cond: str, held: int, labels: bool) -> str:
    by = "PARTITION BY method, path" if labels else ""
    names = "method, path" if labels else "NULL AS method, NULL AS path"
    return (f"SELECT '{alert}' AS alert, t AS bucket_ts, {names}, count(*) FILTER (WHERE {cond}) OVER ({by} ORDER BY t RANGE BETWEEN INTERVAL {held - 1} MINUTE PRECEDING "
            f"AND CURRENT ROW) = {held} AS firing FROM {rows}")


_R5, _R1H, _R7D = (f"(SELECT t, {_ratio(m)} AS r FROM {_GRID})" for m in (5, 60, 7 * 1440))
_THRESHOLDS = " UNION ALL ".join(f"""SELECT '{path}' AS path, {p / 1000}::double AS q, value, value < {most} AS ok FROM (SELECT duration AS value, row_number() OVER (ORDER BY duration) AS k, count(*) OVER () AS n
    FROM {_HTTP} WHERE path = '{path}') WHERE k = greatest(1, (n * {p} + 999) // 1000)""" for path, (p, most) in LIMITS.items())
_LE = " ".join(f"WHEN le = {b}::double THEN '{b:g}'" for b in slo.HTTP_BUCKETS)
_ALPHABET = S.CROCKFORD
_NOW = f"TIMESTAMP '{NOW}'"
_KEYS = f"""(SELECT 'key-' || id AS id, id AS tenant_id, 'tenant' AS scope, 'live_' || sha256(id) AS secret FROM {_T} UNION ALL SELECT 'key-admin', NULL, 'admin', 'live_admin')"""

ORACLE = {
    "rollup_rerun": f"SELECT tenant_id, event_type, cast(occurred_at as date) AS date, count(*) AS event_count, coalesce(cast(sum(cast(value + 1 as decimal(28,4))) as double), 0) AS total_value FROM {_E} WHERE {_WEEK} GROUP BY ALL",
    "rollup_repaired": f"{_ROLL} WHERE {_WEEK} AND NOT (event_type = 'view' AND cast(occurred_at as date) = '2024-01-09') GROUP BY ALL",
    "rollup_differences": f"""WITH a AS ({_ROLL} GROUP BY ALL), b AS (SELECT tenant_id, event_type, date, event_count, total_value + CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS total_value FROM a WHERE event_type <> 'signup'
        UNION ALL SELECT tenant_id, 'tap', date, event_count, total_value + 0.0 FROM a WHERE event_type = 'click')
        SELECT coalesce(a.tenant_id, b.tenant_id) AS tenant_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.date, b.date) AS date, a.event_count AS source_count, b.event_count AS sink_count,
        a.total_value AS source_value, b.total_value AS sink_value FROM a FULL JOIN b ON a.tenant_id = b.tenant_id AND a.event_type = b.event_type AND a.date = b.date
        WHERE a.event_count IS DISTINCT FROM b.event_count OR a.total_value IS DISTINCT FROM b.total_value""",
    "rollup_checksum": f"SELECT tenant_id, sha256(string_agg({_LINE}, '' ORDER BY event_type, date)) AS checksum FROM ({_ROLL} GROUP BY ALL) GROUP BY 1",
    "rollup_checksum_day": f"""SELECT s AS source, s AS rerun, o AS other FROM (SELECT sha256(coalesce(string_agg({_LINE}, '' ORDER BY tenant_id, event_type, date), '')) AS s,
        sha256(coalesce(string_agg({_LINE.replace("cast(event_count as varchar)", "cast(event_count + 1 as varchar)")}, '' ORDER BY tenant_id, event_type, date), '')) AS o FROM {_DAY_ROLL})""",
    "olap_newest_days": f"""SELECT cast(occurred_at as date) AS date, event_type, count(*) AS event_count, {_V} AS total_value FROM (SELECT DISTINCT * FROM {_R}) WHERE tenant_id = '{TENANT}' AND occurred_at >= '{FIRST}'
        AND occurred_at < '{LAST}' GROUP BY ALL ORDER BY 1 DESC, 3 DESC, 2 LIMIT 20""",
    "olap_ranges": "SELECT * FROM (VALUES (0, DATE '2023-12-17', DATE '2024-01-16'), (1, DATE '2024-01-05', DATE '2024-01-16'), (2, DATE '2023-12-21', DATE '2024-01-20'), (3, DATE '2023-02-01', DATE '2024-01-31')) v(request, first, last)",
    "final_subsecond": f"""SELECT tenant_id, event_id, occurred_at, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, date_trunc('second', occurred_at), event_id ORDER BY occurred_at DESC, event_type DESC, payload DESC, value DESC) AS k
        FROM (SELECT * FROM {_E} UNION ALL SELECT event_id, tenant_id, event_type, payload, -value, date_trunc('second', occurred_at) + INTERVAL 999 MILLISECOND FROM {_E} WHERE event_id % 10 = 0)) WHERE k = 1""",
    "tenants_newest": "SELECT id, name, created_at AT TIME ZONE 'UTC' AS created_at FROM tenants ORDER BY tenants.created_at DESC NULLS LAST, id LIMIT 100",
    "audit_newest": "SELECT id, tenant_id, action, occurred_at AT TIME ZONE 'UTC' AS occurred_at FROM audit_log WHERE resource_id IS NOT NULL AND tenant_id IS NOT NULL ORDER BY audit_log.occurred_at DESC NULLS LAST, id LIMIT 100",
    "pii_scan_counts": "SELECT count(*) AS scanned, count(*) FILTER (WHERE " + " OR ".join(f"regexp_matches(payload, '{p}')" for p in S.CATEGORIES.values()) + ") AS with_pii, "
                       + ", ".join(f"count(*) FILTER (WHERE regexp_matches(payload, '{p}')) AS {k}" for k, p in S.CATEGORIES.items())
                       + " FROM (SELECT payload FROM usage_events WHERE occurred_at >= '2000-01-01' ORDER BY occurred_at DESC NULLS LAST, delivery_id LIMIT 10000)",
    "masked_documents": f"SELECT doc_id, coalesce(contains({_MASKED}, '{S.REDACTED}'), false) AS masked FROM documents",
    "tenants_active": "SELECT id, plan FROM tenants t WHERE EXISTS (SELECT 1 FROM usage_events u WHERE u.tenant_id = t.id)",
    "idempotency_expired": f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'in_flight' ELSE 'completed' END AS state FROM {_E}
        WHERE occurred_at < {_NOW} - CASE WHEN event_id % 3 = 0 THEN INTERVAL 5 MINUTE ELSE INTERVAL 24 HOUR END""",
    "projection_kinds": f"SELECT tenant_id, event_type, count(*) AS event_count, {_V} AS total_value, (SELECT max(event_id) + 1 FROM events) AS position FROM {_E} WHERE (event_id + 1) % 4 <> 0 GROUP BY ALL",
    "projection_rebuilt": f"SELECT tenant_id, cast(occurred_at as date) AS event_date, event_type, count(*) AS event_count, {_V} AS total_value FROM {_E} GROUP BY ALL",
    "api_keys": f"SELECT id, tenant_id, scope, substr(secret, 1, 16) AS prefix, sha256(secret) AS key_hash FROM {_KEYS}",
    "key_touched": f"""WITH u AS (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN occurred_at END AS l FROM {_E})
        SELECT 'key-1' AS id, event_id, CASE WHEN l IS NULL OR l < {_NOW} - INTERVAL 5 MINUTE THEN {_NOW} ELSE l END AS last_used_at FROM u UNION ALL SELECT 'key-2', event_id, l FROM u""",
    "key_revoked": f"SELECT id, CASE WHEN id = 'key-3' THEN TIMESTAMP '1970-01-01 00:01:40' END AS revoked_at FROM {_KEYS}",
    "key_permitted": f"""SELECT event_id, key_id, tenant_id FROM (SELECT event_id, tenant_id AS owner, CASE WHEN event_id % 7 = 0 THEN 'key-admin' ELSE 'key-' || tenant_id END AS key_id,
        CASE WHEN event_id % 3 = 0 THEN '1' ELSE tenant_id END AS tenant_id FROM {_E}) WHERE key_id = 'key-admin' OR owner = tenant_id""",
    "shard_read": f"""SELECT event_id, event_type, value, cast(('0x' || substr(sha256(tenant_id), 1, 16))::ubigint % 4 as int) AS shard, strftime(occurred_at, '%Y%m') AS month FROM {_E} WHERE tenant_id = '{TENANT}'""",
    "window_keys": f"""SELECT event_id, CASE WHEN ok THEN '1m' END AS duration, CASE WHEN ok THEN tenant_id END AS tenant_id, CASE WHEN ok THEN event_type END AS event_type,
        CASE WHEN ok AND event_id % 5 > 0 THEN date_trunc('second', occurred_at) END AS window_start, CASE WHEN ok THEN event_id % 5 = 0 END AS is_late FROM (SELECT *, event_id % 5 NOT IN (1, 2) AS ok FROM {_E})""",
    "scalar_conversions": f"""SELECT event_id, epoch_us(occurred_at) // 1000000 AS unix_s, occurred_at AS of_nanos, date_trunc('millisecond', occurred_at) AS of_ulid, {_PLAIN.format('value')} AS value_text,
        cast(event_id + 1 as varchar) || '000000000' AS large_text, 'main_shard' || cast(event_id % 4 as varchar) AS database,
        replace(translate(base64(from_hex(sha256(tenant_id))), '+/', '-_'), '=', '') AS secret, greatest(value, event_id % 50 + 1.0::double) / nullif(least(value, event_id % 50 + 1.0::double), 0) AS times,
        CASE WHEN value > event_id % 50 + 1.0::double THEN 'faster' ELSE 'slower' END AS label, 'envelope' AS merged_a, 'super' AS merged_b, event_type AS merged_c FROM {_E}""",
    "protobuf_decoded": f"SELECT event_id, cast(event_id as varchar) AS id, tenant_id, event_type, payload, value, epoch_us(occurred_at) * 1000 AS occurred_ns, cast(NULL as varchar) AS error FROM {_E}",
    "protobuf_broken": f"SELECT event_id, event_id % 2 = 0 AS broken, CASE WHEN event_id % 2 = 1 THEN tenant_id END AS tenant_id FROM {_E}",
    "ingest_rows": """SELECT row_number() OVER (ORDER BY event_id) - 1 AS index, CASE WHEN event_id % 50 <> 0 THEN cast(event_id as varchar) END AS id, cast(CASE WHEN event_id % 50 = 0 THEN 400 ELSE 201 END as int) AS status,
        CASE WHEN event_id % 50 = 0 THEN 'EVENT_TYPE_REQUIRED' END AS code, CASE WHEN event_id % 50 = 0 THEN 'event_type is required' END AS error FROM (SELECT * FROM events ORDER BY event_id LIMIT 500)""",
    "dual_written": f"SELECT tenant_id, count(*) AS logged, max(p) AS last, count(*) AS stored FROM (SELECT *, row_number() OVER (ORDER BY occurred_at, event_id) AS p FROM {_E}) GROUP BY 1",
    "outbox_swept": f"""WITH l AS {_L}, due AS (SELECT id FROM l WHERE pending ORDER BY created_at, id LIMIT 100)
        SELECT id, CASE WHEN NOT pending THEN created_at WHEN id IN (SELECT id FROM due) AND id % 7 <> 0 THEN {_NOW} END AS outbox_sent_at FROM l""",
    "export_parts": f"""SELECT 'tenant' AS part, count(*) AS lines, cast(NULL as bigint) AS last_event, max(plan) AS plan, cast(NULL as varchar) AS purpose FROM {_T} WHERE id = '{TENANT}' HAVING count(*) > 0
        UNION ALL SELECT 'event', count(*), max(event_id), NULL, NULL FROM {_E} WHERE tenant_id = '{TENANT}' HAVING count(*) > 0
        UNION ALL SELECT 'consent', count(DISTINCT tenant_id), NULL, NULL, 'analytics' FROM {_E} WHERE tenant_id = '{TENANT}' AND event_type = 'signup' HAVING count(*) > 0""",
    "erase_tenants": f"SELECT tenant_id, count(*) AS events FROM {_E} WHERE tenant_id NOT IN (SELECT id FROM {_T} WHERE plan = 'free') GROUP BY 1",
    "slo_quantiles_5m": f"SELECT a.t AS bucket_ts, method, path, round(a.v, 9) AS p50, round(b.v, 9) AS p95, round(c.v, 9) AS p99 FROM {_q5(0.5)} a JOIN {_q5(0.95)} b USING (t, method, path) JOIN {_q5(0.99)} c USING (t, method, path)",
    "slo_worst_p99": f"SELECT t AS bucket_ts, round(max(v), 9) AS worst FROM {_q5(0.99)} GROUP BY 1",
    "slo_rolling_ratios": f"SELECT t AS bucket_ts, round({_ratio(5)}, 9) AS ratio_5m, round({_ratio(60)}, 9) AS ratio_1h, round({_ratio(360)}, 9) AS ratio_6h, round(1.0::double - {_ratio(7 * 1440)} / 0.005::double, 9) AS budget_left FROM {_GRID}",
    "slo_alerts": " UNION ALL ".join([
        _held("tenant_p99", f"(SELECT * FROM {_q5(0.99)} WHERE path LIKE '/api/v1/tenants%')", "v > 0.2", 6, True),
        _held("ingest_p99", f"(SELECT * FROM {_q5(0.99)} WHERE path = '/api/v1/events' AND method = 'POST')", "v > 0.5", 6, True),
        _held("read_p95", f"(SELECT * FROM {_q5(0.95)} WHERE path LIKE '/api/v1/events%' AND method = 'GET')", "v > 0.3", 6, True),
        _held("fast_burn", _R5, "r > 0.02", 3, False), _held("slow_burn", _R1H, "r > 0.005", 16, False), _held("budget_exhausted", _R7D, "1.0::double - r / 0.005::double < 0", 6, False)]),
    "load_thresholds": _THRESHOLDS,
    "metrics_exposition": f"""SELECT 'requests_total{{method="' || method || '",path="' || path || '",status="' || status || '"}} ' || cast(count(*) as varchar) AS line FROM {_HTTP} GROUP BY method, path, status
        UNION ALL SELECT 'request_duration_seconds_bucket{{method="' || method || '",path="' || path || '",le="' || CASE WHEN isinf(le) THEN '+Inf' {_LE} END || '"}} ' || cast(count(*) FILTER (WHERE duration <= le OR isinf(le)) as varchar)
        FROM {_HTTP}, (VALUES {_BOUNDS}) b(le) GROUP BY method, path, le""",
    "olap_histogram": _HIST.split(" UNION ALL ")[-1] + "".join(f" UNION ALL SELECT path, {b} AS le, count(*) FILTER (WHERE duration <= {b}) AS n FROM (SELECT event_type AS path, value / 1000 AS duration FROM events) GROUP BY path" for b in slo.OLAP_BUCKETS),
    "stream_topic": f"SELECT cast(event_id as varchar) AS event_id, tenant_id, event_type, payload, value, occurred_at FROM {_E}",
    "stream_dead_letters": f"""SELECT 'handler_failed_after_retries' AS reason, cast(3 as bigint) AS attempts, count(*) AS messages, count(DISTINCT tenant_id) AS tenants, count(*) AS places FROM {_E} WHERE event_type = 'error' HAVING count(*) > 0
        UNION ALL SELECT 'unmarshal_failed', 1, 2, 0, 2""",
    "stream_projection": f"SELECT tenant_id, cast(occurred_at as date) AS event_date, event_type, count(*) AS event_count, {_V} AS total_value FROM {_E} GROUP BY ALL",
    "stream_history": f"""SELECT tenant_id, event_type, '1h' AS window_duration, window_start, event_count, sum_value, false AS is_late FROM ({_window(3600)})
        WHERE (SELECT max(watermark) FROM {_M}) >= window_start + INTERVAL 3630 SECOND
        UNION ALL SELECT tenant_id, event_type, window_duration, TIMESTAMP '2027-01-15 08:00:01', event_count, sum_value, true FROM ({_late('1h')})""",
    "stream_frames": f"""SELECT tenant_id, event_type, '1h' AS window_label, window_start, coalesce(event_count, 0) AS event_count, coalesce(sum_value, 0) AS sum_value, 'watermark' AS based_on, (SELECT max(watermark) FROM {_M}) AS watermark
        FROM (SELECT DISTINCT tenant_id, event_type, (SELECT date_trunc('hour', max(watermark)) FROM {_M}) AS window_start FROM {_E}) k LEFT JOIN ({_window(3600)}) USING (tenant_id, event_type, window_start)""",
    # Folds whose next state depends on what was decided before: recursion, one step for the n-th row of every key.
    "charge_fold": f"""WITH RECURSIVE l AS (SELECT tenant_id, amount_cents, 'k' || cast(id % 9 as varchar) AS key, row_number() OVER (PARTITION BY tenant_id ORDER BY epoch_us(created_at) // 1000000 * 10000000 + id) AS k FROM {_L}),
        opening AS (SELECT tenant_id, cast(trunc(cast(sum(amount_cents) as bigint) / 2) as bigint) AS balance FROM {_L} GROUP BY 1),
        step AS (SELECT tenant_id, cast(0 as bigint) AS k, balance, cast(0 as bigint) AS accepted, cast(0 as bigint) AS rejected, cast(0 as bigint) AS replayed, cast([] as varchar[]) AS keys FROM opening
            UNION ALL SELECT s.tenant_id, l.k, CASE WHEN ok THEN balance - amount_cents ELSE balance END, accepted + cast(ok as int), rejected + cast(NOT ok AND NOT again as int), replayed + cast(again as int),
                CASE WHEN ok THEN list_append(keys, l.key) ELSE keys END
            FROM step s JOIN (SELECT * FROM l) l ON l.tenant_id = s.tenant_id AND l.k = s.k + 1, LATERAL (SELECT list_contains(s.keys, l.key) AS again), LATERAL (SELECT NOT again AND l.amount_cents > 0 AND l.amount_cents <= s.balance AS ok))
        SELECT tenant_id, arg_max(accepted, k) AS accepted, arg_max(rejected, k) AS rejected, arg_max(replayed, k) AS replayed, arg_max(balance, k) AS balance_cents FROM step GROUP BY 1 HAVING max(k) > 0""",
    "idempotency_outcomes": f"""WITH RECURSIVE q AS (SELECT 't:' || tenant_id || ':' || event_type AS key, epoch_us(occurred_at) / 1e6::double AS at_s, event_id % 3 = 0 AS print, event_id % 4 <> 0 AS fine,
            row_number() OVER (PARTITION BY tenant_id, event_type ORDER BY occurred_at) AS k FROM {_E}),
        step AS (SELECT key, k, at_s, 'reserved' AS outcome, false AS complete, print, fine, at_s AS since FROM q WHERE k = 1
            UNION ALL SELECT q.key, q.k, q.at_s, CASE WHEN free THEN 'reserved' WHEN s.print <> q.print THEN 'reused' WHEN whole THEN 'replay' ELSE 'in_progress' END,
                NOT free AND whole, CASE WHEN free THEN q.print ELSE s.print END, CASE WHEN free THEN q.fine ELSE s.fine END, CASE WHEN free THEN q.at_s ELSE held_since END
            FROM step s JOIN q ON q.key = s.key AND q.k = s.k + 1,
                LATERAL (SELECT NOT s.complete AND q.at_s >= s.since + 5400.0 AS ended), LATERAL (SELECT s.complete OR ended AND s.fine AS whole, CASE WHEN ended AND s.fine THEN s.since + 5400.0 ELSE s.since END AS held_since),
                LATERAL (SELECT ended AND NOT s.fine OR whole AND q.at_s >= held_since + 86400.0 AS free))
        SELECT key AS ns_key, at_s, outcome FROM step""",
    "token_bucket": f"""WITH RECURSIVE q AS (SELECT tenant_id AS key, epoch_us(occurred_at) / 1e6::double AS at_s, row_number() OVER (PARTITION BY tenant_id ORDER BY occurred_at) AS k FROM {_E}),
        step AS (SELECT key, k, at_s, true AS allowed, 0.0::double AS retry, 2.0::double AS tokens, at_s AS t FROM q WHERE k = 1
            UNION ALL SELECT q.key, q.k, q.at_s, have >= 1, CASE WHEN have >= 1 THEN 0.0::double ELSE (1.0::double - have) / 0.0005::double END, CASE WHEN have >= 1 THEN have - 1 ELSE have END, greatest(s.t, q.at_s)
            FROM step s JOIN q ON q.key = s.key AND q.k = s.k + 1, LATERAL (SELECT least(3.0::double, s.tokens + greatest(0.0::double, q.at_s - s.t) * 0.0005::double) AS have))
        SELECT key, at_s, allowed, retry AS retry_after_s, cast(floor(tokens) as bigint) AS remaining FROM step""",
    "breaker_transitions": f"""WITH RECURSIVE q AS (SELECT tenant_id AS key, epoch_us(occurred_at) / 1e6::double AS at_s, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY tenant_id ORDER BY occurred_at) AS k FROM {_E}),
        step AS (SELECT key, cast(0 as bigint) AS k, at_s, cast(NULL as varchar) AS seen, 'closed' AS state, 0 AS fails, at_s AS since, 0 AS good FROM q WHERE k = 1
            UNION ALL SELECT q.key, q.k, q.at_s, now_state,
                CASE WHEN now_state = 'open' THEN 'open' WHEN q.ok THEN CASE WHEN now_state = 'half_open' AND now_good + 1 >= 3 THEN 'closed' ELSE now_state END
                     WHEN now_state = 'half_open' OR now_fails + 1 >= 2 THEN 'open' ELSE now_state END,
                CASE WHEN now_state = 'open' THEN now_fails WHEN q.ok THEN 0 WHEN now_state = 'half_open' OR now_fails + 1 >= 2 THEN 0 ELSE now_fails + 1 END,
                CASE WHEN now_state = 'open' THEN now_since WHEN q.ok THEN CASE WHEN now_state = 'half_open' AND now_good + 1 >= 3 THEN q.at_s ELSE now_since END
                     WHEN now_state = 'half_open' OR now_fails + 1 >= 2 THEN q.at_s ELSE now_since END,
                CASE WHEN now_state <> 'open' AND q.ok THEN now_good + 1 ELSE now_good END
            FROM step s JOIN q ON q.key = s.key AND q.k = s.k + 1,
                LATERAL (SELECT CASE WHEN s.state = 'open' AND q.at_s - s.since >= 3600.0 THEN 'half_open' ELSE s.state END AS now_state),
                LATERAL (SELECT CASE WHEN s.state = 'open' AND now_state = 'half_open' THEN 0 ELSE s.good END AS now_good, s.state = 'closed' AND q.at_s - s.since >= 1e9 AS anew),
                LATERAL (SELECT CASE WHEN anew THEN 0 ELSE s.fails END AS now_fails, CASE WHEN anew THEN q.at_s ELSE s.since END AS now_since))
        SELECT key, at_s, was AS from_state, seen AS to_state FROM (SELECT key, at_s, seen, lag(seen) OVER (PARTITION BY key ORDER BY k) AS was FROM step WHERE k > 0) WHERE was <> seen""",
}
