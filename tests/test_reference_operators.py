import datetime as dt
import functools
import hashlib

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline import schemas, scratch
from driftline.functions import codec
from driftline.functions import scalar as S
from driftline.operators import final, ingest, joins, keys, ledger, machines, masking, privacy, projections, rollup, search, shard, slo, windows
from driftline.plans import reference
from driftline.sources import event_log, fixtures
from tests.conftest import rows

T0 = dt.datetime(2024, 3, 15, 10)


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()[0]


# Wire format


def test_wire_golden_bytes():
    raw = codec.encode_message("id1", "t1", "view", "{}", 1.5, 1_000_000_000)
    assert raw.hex() == "0a0369643112027431" "1a047669657722027b7d" "29000000000000f83f" "308094ebdc03"
    assert codec.decode_message(raw) == {"id": "id1", "tenant_id": "t1", "event_type": "view", "payload": "{}", "value": 1.5, "occurred_ns": 1_000_000_000}
    for extra in ("4d0000803f", "4801", "5203616263", "41" + "00" * 8):
        assert codec.decode_message(raw + bytes.fromhex(extra))["value"] == 1.5
    for bad in (raw[:-1], raw + b"\x4b", raw + b"\x0a\x05ab"):
        with pytest.raises(ValueError):
            codec.decode_message(bad)
    assert codec.encode_message("", "", "", "", 0.0, 0) == b""


@given(st.text(max_size=20), st.text(max_size=20), st.floats(allow_nan=False), st.integers(-(2**63), 2**63 - 1))
def test_wire_round_trip(a, b, v, ns):
    got = codec.decode_message(codec.encode_message(a, b, "k", a + b, v, ns))
    assert (got["id"], got["tenant_id"], got["payload"], got["value"], got["occurred_ns"]) == (a, b, a + b, v, ns)


def test_bad_messages_are_errors_not_failures(spark):
    got = spark.createDataFrame([(b"\x0a\x01a",), (b"\x0a\x09a",), (None,)], "v binary").select(codec.decode_events("v").alias("d")).select("d.id", "d.error").collect()
    assert got[0].id == "a" and got[0].error is None and got[1].error and got[2].error


def test_float_text():
    assert [codec.plain_float(x) for x in (6.0, 1e7, 0.1, 1e-7, -2.5, 1e21)] == ["6", "10000000", "0.1", "0.0000001", "-2.5", "1000000000000000000000"]


def test_ulid_time(spark):
    u = codec.new_ulid(1_735_718_400_123)
    assert len(u) == 26
    assert one(spark, F.unix_millis(S.ulid_time("u")), u=u) == 1_735_718_400_123


# Scalars


@pytest.mark.parametrize("key,ok", [("window:1m:tenant-A:page_view:1735718400", True), ("window:1m:t", False), ("state:1m:t:e:1735718400", False),
                                    ("window:1m:t:e:not-a-time", False), ("window:1h:t:e:late", True)])
def test_window_keys(spark, key, ok):
    got = one(spark, S.parse_window_key("k"), k=key)
    assert (got is not None) == ok
    if ok:
        assert got.is_late == key.endswith("late")


def test_backoff_lag_and_clamps(spark):
    assert [one(spark, S.backoff_ms(F.lit(n), 100, 1000)) for n in range(1, 7)] == [100, 200, 400, 800, 1000, 1000]
    assert [one(spark, S.lag_status(F.lit(x))) for x in (0, 1, (1 << 20) - 1, 1 << 20, 10 << 20)] == ["caught_up", "healthy", "healthy", "lagging", "critical"]
    assert one(spark, S.lag_bytes(F.lit(5), F.lit(9))) == 0
    assert [S.limit_or(n, 100, 1000) for n in (None, 0, 1, 1000, 1001)] == [100, 100, 1, 1000, 100]
    assert [S.duration_label(x) for x in (60, 3600, 37, 90, 86400)] == ["1m", "1h", "37s", "1m30s", "24h0m0s"]


def test_truncation_counts_from_year_one(spark):
    zero = dt.datetime(1, 1, 1)
    for seconds in (37, 60, 7 * 86400):
        want = T0 - dt.timedelta(seconds=(T0 - zero).total_seconds() % seconds)
        assert one(spark, S.truncate_to("t", seconds), t=T0) == want


def test_later_maps_win(spark):
    got = one(spark, S.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))))
    assert got == {"a": 1, "b": 2}


@pytest.mark.parametrize("text,found", [('{"email": "alice@example.com"}', ["email"]), ('{"ip": "203.0.113.7"}', ["ip_address"]),
                                        ('{"page": "/pricing", "duration_ms": 142}', []), ('{"e": "a@b.co", "ip": "10.0.0.1"}', ["email", "ip_address"])])
def test_pii_categories(spark, text, found):
    assert one(spark, S.pii_categories("t"), t=text) == found
    assert one(spark, S.contains_pii("t"), t=text) == bool(found)
    assert one(spark, S.is_masked(S.mask_pii("t")), t=text) == bool(found)


def test_selective_masking(spark):
    assert one(spark, S.mask_pii("t", ["email"]), t="a@b.co 10.0.0.1") == "[REDACTED] 10.0.0.1"


def test_shards_are_balanced_and_stable(spark):
    ids = [f"tenant-{i:06d}" for i in range(1000)]
    got = {r.tenant_id: r.shard for r in shard.with_shard(spark.createDataFrame([(i,) for i in ids], "tenant_id string")).collect()}
    assert all(got[i] == int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "big") % 4 for i in ids)
    assert all(200 <= sum(s == k for s in got.values()) <= 300 for k in range(4))


# Rollup


def roll(spark, data):
    return spark.createDataFrame(data, "tenant_id string, event_type string, date date, event_count long, total_value double")


def test_checksum(spark):
    data = [("t2", "a", dt.date(2024, 3, 15), 3, 6.0), ("t1", "b", dt.date(2024, 3, 15), 1, 0.5), ("t1", "a", dt.date(2024, 3, 16), 1, 1e7)]
    text = "".join(sorted(f"{t}|{e}|{d}|{c}|{codec.plain_float(v)}\n" for t, e, d, c, v in data))
    assert rollup.checksum(roll(spark, data)) == rollup.checksum(roll(spark, data[::-1])) == hashlib.sha256(text.encode()).hexdigest()
    assert rollup.checksum(roll(spark, [])) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    for i, v in ((0, "x"), (1, "x"), (2, dt.date(2024, 1, 1)), (3, 9), (4, 9.0)):
        other = [tuple(v if j == i else x for j, x in enumerate(data[0])), *data[1:]]
        assert rollup.checksum(roll(spark, other)) != rollup.checksum(roll(spark, data))
        assert rows(rollup.fast_checksum(roll(spark, other))) != rows(rollup.fast_checksum(roll(spark, data)))


def test_rollup_checksum_covers_every_tenant(spark, monkeypatch):
    data = [(i, t, e, "{}", v, T0 + dt.timedelta(days=i % 2)) for i, (t, e, v) in enumerate([("7", "a", 1.0), ("8", "a", 2.0), ("8", "b", 0.5), ("8", "a", 3.0), ("9", "a", 1e7)])]
    at = [data]
    monkeypatch.setattr(fixtures, "events", lambda spark, d: events(spark, at[0]))
    before = rows(reference.rollup_checksum(spark, ""))
    lines = {"7": ["7|a|2024-03-15|1|1.0"], "8": ["8|a|2024-03-16|2|5.0", "8|b|2024-03-15|1|0.5"], "9": ["9|a|2024-03-15|1|1e7"]}
    text = {t: "".join("|".join([*x.split("|")[:4], codec.plain_float(float(x.split("|")[4]))]) + "\n" for x in ls) for t, ls in lines.items()}
    assert before == [(t, hashlib.sha256(text[t].encode()).hexdigest()) for t in sorted(text)]
    for i, tenant in enumerate(["7", "8", "8", "8", "9"]):
        at[0] = [(*r[:4], r[4] + 1.0, r[5]) if j == i else r for j, r in enumerate(data)]
        assert {t for t, _ in set(rows(reference.rollup_checksum(spark, ""))) - set(before)} == {tenant}


def events(spark, data):
    return spark.createDataFrame(data, "event_id long, tenant_id string, event_type string, payload string, value double, occurred_at timestamp")


def test_rerun_validate_and_repair(spark, tmp_path):
    path, day = f"file://{tmp_path}/rollup", dt.date(2024, 3, 15)
    ev = events(spark, [(i, "t", "page_view", "{}", float(i), T0) for i in (1, 2, 3)])
    for hour in (1, 2):
        rollup.run(ev, path, day, day + dt.timedelta(days=1), T0 + dt.timedelta(hours=hour))
    sink = spark.read.schema(schemas.SCHEMAS["tenant_daily_stats"]).parquet(path)
    assert rows(final.final_rollup(sink), "event_count", "total_value") == [(3, 6.0)]
    rollup.validate(ev, sink, day)
    fewer = ev.where("event_id > 1")
    with pytest.raises(ValueError, match="1 rows"):
        rollup.validate(fewer, sink, day)
    assert rows(rollup.differences(fewer, sink), "source_count", "sink_count") == [(2, 3)]
    rollup.repair(ev.where("false"), path, day, T0)
    assert spark.read.schema(schemas.SCHEMAS["tenant_daily_stats"]).parquet(path).count() == 0


def test_daily_stats_arguments():
    today = dt.date(2024, 3, 15)
    assert rollup.olap_range(None, None, today) == (dt.date(2024, 2, 15), dt.date(2024, 3, 16))
    for first, last in (("2020-01-01", "2026-01-01"), ("notadate", None), ("2024-01-02", "2024-01-02")):
        with pytest.raises(ValueError):
            rollup.olap_range(first, last, today)


def test_latest_wins(spark):
    df = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", 1), ("a", 2, "y", 1), ("b", None, "z", 3), (None, 1, "w", 4), (None, 0, "v", 5)], "k string, version int, s string, n int")
    assert rows(final.latest(df, ["k"], ["version"])) == sorted([("a", 2, "y", 1), ("b", None, "z", 3), (None, 1, "w", 4)], key=repr)
    assert final.latest(df.where("false"), ["k"], ["version"]).count() == 0


# Projections and log


def test_log_append_positions_and_cursors(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    ev = events(spark, [(i, f"t{i % 2}", "view", None if i == 3 else '{"k": 1}', 1.0, T0 + dt.timedelta(seconds=i)) for i in range(1, 6)])
    assert event_log.append(ev, path) == 5
    assert event_log.append(ev, path) == 10
    log = event_log.read(spark, path)
    assert [r.stream_position for r in log.orderBy("stream_position").collect()] == list(range(1, 11))
    assert event_log.after(log, 7, 2).count() == 2 and event_log.after(log, 7, 99_999).count() == 3
    assert [r.stream_position for r in event_log.stream(log, "tenant-t1").collect()] == [1, 3, 5, 6, 8, 10]
    assert event_log.head(log.where("false")) == 0


def test_whole_table_is_numbered_without_gaps(spark):
    d = "/root/testdata/sf0.001"
    got = {r["event_id"]: r["stream_position"] for r in reference.QUERIES["log_positions_all"](spark, d).collect()}
    order = [r["event_id"] for r in fixtures.events(spark, d).orderBy("occurred_at", "event_id").select("event_id").collect()]
    assert got == {e: 1001 + i for i, e in enumerate(order)}


def test_projection_resumes_after_its_position(spark, tmp_path):
    log = fixtures.log(spark, "/root/testdata/sf0.001")
    p, root = projections.RunningTotals(), f"file://{tmp_path}/p"
    head = event_log.head(log)
    assert p.catch_up(log, root, head=head // 3) == head // 3
    assert p.catch_up(log, root, head=head // 3) == head // 3
    assert p.catch_up(log, root) == head
    assert rows(p.state(spark, root), "tenant_id", "event_type", "event_count") == rows(p.transform(log), "tenant_id", "event_type", "event_count")
    assert p.rebuild(log, root) == head
    lag = rows(projections.lag(spark.createDataFrame([("a", 90), ("b", 50)], "projection string, last_position long"), log.where("stream_position <= 100")), "projection", "lag")
    assert lag == [("a", 10), ("b", 50)]


def test_poison_event_fails(spark):
    log = spark.createDataFrame([(1, "s", "EventIngested", "not json", "{}", T0)], schemas.SCHEMAS["event_log"])
    with pytest.raises(Exception):
        projections.DailyCounts().transform(log).collect()


# Windows


def test_window_boundaries(spark):
    at = lambda h, m, s: dt.datetime(2024, 3, 15, h, m, s)
    for wm, closed in ((at(10, 1, 29), False), (at(10, 1, 30), True)):
        assert one(spark, windows.is_closed(F.col("s"), 60, F.col("w")), s=at(10, 0, 0), w=wm) == closed
    df = spark.createDataFrame([(1, "t", "e", 1.0, at(10, 5, 0), at(10, 5, 0)), (2, "t", "e", 1.0, at(10, 4, 30), at(10, 5, 1)), (3, "t", "e", 1.0, at(10, 4, 29), at(10, 5, 2))],
                               "event_id long, tenant_id string, event_type string, value double, occurred_at timestamp, received_at timestamp").withColumn("delivery_id", F.col("event_id"))
    assert rows(windows.with_watermark(df), "event_id", "is_late") == [(1, False), (2, False), (3, True)]


def test_five_deliveries_count_once(spark):
    df = spark.createDataFrame([(7, "t", "e", 10.0, T0, T0 + dt.timedelta(seconds=i), i) for i in range(5)],
                               "event_id long, tenant_id string, event_type string, value double, occurred_at timestamp, received_at timestamp, delivery_id long")
    got = windows.tumbling(windows.first_deliveries(windows.with_watermark(df), 3600), 3600)
    assert rows(got, "event_count", "sum_value") == [(1, 10.0)]


# Privacy


def test_erasure_and_anonymisation(spark):
    tenants = spark.createDataFrame([("7", "n", "free", T0, T0), ("8", "m", "pro", T0, T0)], schemas.SCHEMAS["tenants"])
    ev = spark.createDataFrame([("1", "7", "e", '{"email":"alice@example.com","client_ip":"203.0.113.7"}', 1.0, T0, False), ("2", "7", "e", "{}", 1.0, T0, False), ("3", "8", "e", "a@b.co", 1.0, T0, None),
                                ("4", "7", "e", "a@b.co", 1.0, T0, True)], schemas.SCHEMAS["events"])
    left = privacy.erase({"tenants": tenants, "events": ev, "audit_log": ev}, "7")
    assert [left[k].count() for k in ("tenants", "events", "audit_log")] == [1, 1, 4]
    with pytest.raises(LookupError):
        privacy.erase({"tenants": tenants}, "9")
    masked, counters = privacy.anonymise_events(ev, "7")
    assert tuple(counters.first()) == (2, 2)
    assert [r.payload for r in masked.orderBy("event_id").collect()] == ['{"email":"[REDACTED]","client_ip":"[REDACTED]"}', "{}", "a@b.co", "a@b.co"]
    log = spark.createDataFrame([(1, "tenant-7", "EventIngested", '{"tenant_id":"7","event_type":"e","payload":"a@b.co","value":1.0,"id":"x"}', "{}", T0),
                                 (2, "tenant-7", "EventIngested", '{"tenant_id":"7","event_type":"e","payload":"{}","value":1.0,"id":"446655440000"}', "{}", T0)], schemas.SCHEMAS["event_log"])
    clean, counters = privacy.anonymise_log(log, "7")
    assert tuple(counters.first()) == (2, 1)
    assert "446655440000" in clean.where("stream_position = 2").first().data
    assert privacy.export(tenants, ev, ev.where("false"), "7").count() == 4


def test_consent_fold(spark):
    log = spark.createDataFrame([("a", "p", "revoke", 1), ("a", "p", "grant", 2), ("b", "p", "grant", 1), ("b", "p", "revoke", 2), ("c", "p", "revoke", 1), ("d", "p", "grant", 1), ("d", "p", "revoke", 2), ("d", "p", "grant", 3)],
                                "tenant_id string, purpose string, action string, seq long")
    current = privacy.consent(log)
    assert rows(current, "tenant_id", "state") == [("a", 1), ("b", 2), ("d", 1)]
    keyed = spark.createDataFrame([("b",), ("c",), ("z",)], "tenant_id string")
    assert rows(privacy.gate(keyed, current, "p")) == [("c",), ("z",)]
    assert rows(privacy.consent_state(keyed.withColumn("purpose", F.lit("p")), current), "tenant_id", "state") == [("b", 2), ("c", 0), ("z", 0)]


# Ledger and machines


def test_insufficient_credit_is_refused(spark):
    got = ledger.charge(spark.createDataFrame([("a", 50)], "tenant_id string, balance_cents long"),
                        spark.createDataFrame([("a", 1, "k1", 80), ("a", 2, "k2", 30), ("a", 3, "k2", 30), ("a", 4, "k3", 0), ("b", 1, "k", 1)], "tenant_id string, seq long, idempotency_key string, amount_cents long"))
    assert rows(got) == [("a", 1, 2, 1, 20), ("b", 0, 1, 0, 0)]


def test_outbox_leaves_failed_rows_pending(spark):
    cols = "id long, tenant_id string, created_at timestamp, outbox_sent_at timestamp"
    rec = spark.createDataFrame([(1, "a", T0, None), (2, "a", T0 + dt.timedelta(1), None), (3, "a", T0, T0)], cols)
    after = ledger.publish(rec, lambda rows_: rows_.where("id <> 1"), T0)
    assert [r.id for r in ledger.pending(after).collect()] == [1]


def test_fencing(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 9), (5, None), (6, 10)], "event_id long, token long")
    assert [r.accepted for r in machines.fencing(df).orderBy("event_id").collect()] == [True, False, False, True, None, True]


def test_token_bucket(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0, 3.0), ("a", 0.001, 1.0, 3.0), ("a", 0.002, 1.0, 3.0), ("a", 0.003, 1.0, 3.0), ("b", 0.0, 1.0, 3.0), ("a", 1.1, 1.0, 3.0)], "key string, at_s double, rate double, burst double")
    got = {(r.key, r.at_s): r.allowed for r in machines.token_bucket(df).collect()}
    assert [got["a", t] for t in (0.0, 0.001, 0.002, 0.003, 1.1)] == [True, True, True, False, True] and got["b", 0.0]


def test_breaker(spark):
    calls = [(float(i), False) for i in range(5)] + [(6.0, True), (40.0, True), (41.0, True), (42.0, True), (43.0, True)]
    got = machines.breaker(spark.createDataFrame([("op", t, ok) for t, ok in calls], "key string, at_s double, ok boolean")).orderBy("at_s").collect()
    assert [r.state for r in got] == ["closed"] * 5 + ["open"] + ["half_open"] * 3 + ["closed"]
    assert [r.allowed for r in got] == [True] * 5 + [False] + [True] * 4


@pytest.mark.parametrize("floor,watermark,want", [(0, 0, 0), (0, 500, 500), (250, 0, 250), (600, 500, 600), (100, 500, 100)])
def test_required_lsn(spark, floor, watermark, want):
    assert one(spark, machines.required_lsn(F.lit(floor), F.lit(watermark))) == want


def test_idempotency_cleanup(spark):
    df = spark.createDataFrame([("a", "completed", T0 - dt.timedelta(hours=25)), ("b", "completed", T0 - dt.timedelta(hours=23)), ("c", "in_flight", T0 - dt.timedelta(minutes=6)), ("d", "in_flight", T0)],
                               "k string, state string, created_at timestamp")
    assert rows(machines.expired(df, T0), "k") == [("a",), ("c",)]


# Ingest, keys, service levels, schemas


def test_batches(spark):
    df = spark.createDataFrame([("view", ""), ("", "{}"), (None, None)], "event_type string, payload string")
    checked = ingest.validate(df)
    assert rows(checked, "status", "payload") == [(201, "{}"), (400, "{}"), (400, "{}")]
    assert tuple(ingest.batch_status(checked).first()) == (3, 1, 207)
    good, bad = ingest.split(checked)
    assert (good.count(), bad.count()) == (1, 2)
    with pytest.raises(ValueError):
        ingest.check_size(501, 1)


@pytest.mark.parametrize("hours,kept", [(0, True), (23.9, True), (24, False), (-0.9, True), (-1, False)])
def test_client_times(spark, hours, kept):
    t = T0 - dt.timedelta(hours=hours)
    assert one(spark, S.clamp_skew("t", F.col("n")), t=t, n=T0) == (t if kept else T0)


def test_dual_write_once(spark, tmp_path):
    ev = events(spark, [(1, "t", "view", "{}", 1.0, T0)])
    for _ in range(2):
        ingest.dual_write(ev, f"file://{tmp_path}/log", f"file://{tmp_path}/events", "b1")
    assert spark.read.parquet(f"{tmp_path}/log").count() == spark.read.parquet(f"{tmp_path}/events").count() == 1


def test_keys(spark):
    new = spark.createDataFrame([("1", "t1", "tenant", "sk_abcdefghijklmnop"), ("2", None, "admin", "sk_zyxwvutsrqponmlk")], "id string, tenant_id string, scope string, secret string")
    minted = keys.mint(new)
    tenants = spark.createDataFrame([("t1", "pro")], "id string, plan string")
    assert rows(keys.with_tenant(minted, tenants), "id", "plan") == [("1", "pro"), ("2", None)]
    assert keys.lookup(minted, tenants, "sk_abcdefghijklmnop").first().id == "1"
    assert keys.with_tenant(keys.revoke(minted, "1", T0), tenants).count() == 1
    assert keys.ensure(minted, minted).count() == 2
    touched = keys.touch(keys.touch(minted, "1", T0), "1", T0 + dt.timedelta(minutes=1)).where("id = '1'").first()
    assert touched.last_used_at == T0
    asked = spark.createDataFrame([("1", "t1"), ("1", "t2"), ("2", "t2")], "key_id string, tenant_id string")
    assert keys.permitted(asked, minted).count() == 2


def test_quantiles_and_summary(spark):
    m = spark.createDataFrame([(T0, "GET", "/a", "200", d) for d in (0.05, 0.15, 0.15, 99.0)], schemas.SCHEMAS["metrics"])
    h = slo.histogram(m, ["path"])
    assert slo.quantile(h, ["path"], 0.5).first().value == pytest.approx(0.15)
    assert slo.quantile(h, ["path"], 0.99).first().value == 10.0
    assert slo.quantile(h.where("false"), ["path"], 0.5).count() == 0
    s = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 5.0)], "metric string, value double")
    assert rows(slo.summary(s)) == [("a", 1.0, 2.0, 9.0), ("b", 5.0, 5.0, 5.0)]
    minutes = spark.createDataFrame([(T0 + dt.timedelta(minutes=i), 10, 5 if i == 3 else 0) for i in range(6)], "bucket_ts timestamp, requests long, errors long")
    got = [round(r.r5, 3) for r in slo.rolling_error_ratio(minutes, 300, "r5").orderBy("bucket_ts").collect()]
    assert got == [0.0, 0.0, 0.0, 0.125, 0.1, 0.1]
    assert [r.ok for r in slo.thresholds(m, {"/a": (500, 0.2)}).collect()] == [True]


def test_append_only_and_checked_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        schemas.write(schemas.empty(spark, "audit_log"), "audit_log", f"file://{tmp_path}/a", mode="overwrite")
    bad = spark.createDataFrame([("1", "t", "k", -5, "EUR", "pending", None, T0, None)], schemas.SCHEMAS["billing_records"])
    with pytest.raises(Exception, match="check of billing_records"):
        schemas.write(bad, "billing_records", f"file://{tmp_path}/b")


def test_search_and_report(spark):
    ev = events(spark, [(1, "t", "e", '{"k": 9, "m": "a@b.co"}', 1.0, T0), (2, "t", "e", '{"K": 91}', 1.0, T0), (3, "u", "e", None, 1.0, T0)])
    assert rows(search.search(ev, '"k": 9', "t"), "event_id") == [(1,), (2,)]
    assert search.recent(ev, limit=0).count() == 3
    assert '"with_pii": 1' in masking.report(ev)


def test_generator_is_repeatable(spark):
    a, b = fixtures.generate(spark, 100), fixtures.generate(spark, 100)
    assert rows(a) == rows(b)


def test_scratch_uses_the_shared_folder(spark):
    from types import SimpleNamespace as N
    cluster = N(conf=N(get=lambda k, default: "hdfs://shared/ck/" if k == "spark.checkpoint.dir" else default), sparkContext=N(applicationId="app-1"))
    assert scratch.root(cluster) == "hdfs://shared/ck/driftline-app-1"
    t = scratch.table(spark.range(3), "x")
    assert t.count() == 3
    scratch.drop(t)
    assert not scratch.exists(spark, t._driftline_path)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 60)), max_size=30))
def test_charges_match_a_loop(spark, pairs):
    balance, counts, seen = 100, [0, 0, 0], set()
    for k, amount in pairs:
        if k in seen:
            counts[2] += 1
        elif amount > balance:
            counts[1] += 1
        else:
            balance -= amount
            counts[0] += 1
            seen.add(k)
    data = pd.DataFrame([("a", i, str(k), a) for i, (k, a) in enumerate(pairs)], columns=["tenant_id", "seq", "idempotency_key", "amount_cents"])
    df = spark.createDataFrame(data, "tenant_id string, seq long, idempotency_key string, amount_cents long")
    got = rows(ledger.charge(spark.createDataFrame([("a", 100)], "tenant_id string, balance_cents long"), df))
    assert got == ([("a", *counts, balance)] if pairs else [])


def test_idempotency_machine(spark):
    R = "ns_key string, at_s double, fingerprint string, done_s double, code int"
    data = [("a", 0.0, "x", 10.0, 201), ("a", 5.0, "x", 9.0, 201), ("a", 6.0, "y", 9.0, 201), ("a", 10.0, "x", 11.0, 201), ("a", 11.0, "y", 12.0, 201), ("a", 86410.0, "y", 86411.0, 201),
            ("b", 0.0, "x", 10.0, 500), ("b", 9.0, "x", 10.0, 201), ("b", 10.0, "x", 400.0, 201), ("b", 309.0, "x", 310.0, 201), ("b", 310.0, "x", 311.0, 201), (None, 1.0, None, 2.0, 201)]
    got = rows(machines.idempotency(spark.createDataFrame(data, R)))
    want = ["reserved", "in_progress", "reused", "replay", "reused", "reserved", "reserved", "in_progress", "reserved", "in_progress", "reserved", "reserved"]
    assert got == sorted([(k, at, o) for (k, at, *_), o in zip(data, want)], key=repr)
    assert machines.idempotency(spark.createDataFrame([], R)).count() == 0


@pytest.mark.parametrize("hot_rows", [100, 10])
def test_reservations_of_many_keys(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(machines, "lookup_join", functools.partial(joins.lookup_join, limit=0))
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    data = [("hot" if i % 3 == 0 else None if i % 31 == 1 else f"k{i % 13}", i, None if i % 5 == 0 else f"p{i % 4}") for i in range(90)]
    got = machines.reservations(spark.createDataFrame(data, "ns_key string, seq long, fingerprint string"))
    first = {}
    for k, i, p in data:
        first.setdefault(k, (i, p))
    assert rows(got, "ns_key", "seq", "winner_id", "outcome") == sorted(
        [(k, i, first[k][0], "reserved" if i == first[k][0] else "replay" if p == first[k][1] else "reused") for k, i, p in data], key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and ("Generate" in plan) == (hot_rows == 10)  # only hot keys are copied


def test_alerts_hold_across_midnight(spark):
    at = dt.datetime(2024, 1, 1, 23, 58)
    data = [(at + dt.timedelta(minutes=i), 1.0 if 1 <= i <= 5 else 0.0) for i in range(8) if i != 4]  # a minute without an evaluation
    got = slo.firing(spark.createDataFrame(data, "bucket_ts timestamp, r double"), F.col("r") > 0.5, 3, "x", step=60)
    assert [r.bucket_ts for r in got.where("firing").collect()] == [at + dt.timedelta(minutes=3)]
    assert got.count() == 7


def test_rolling_ratios_over_days(spark):
    data = [(dt.datetime(2024, 1, 1 + i // 1440, i // 60 % 24, i % 60), i % 7, (i % 5 == 0) * (i % 7 > 0)) for i in range(0, 4000, 13)]
    df = spark.createDataFrame([(t, n, e) for t, n, e in data], "bucket_ts timestamp, requests long, errors long")
    for seconds in (300, 3600, 2 * 86400):
        got = {r.bucket_ts: r.x for r in slo.rolling_error_ratio(df, seconds, "x").collect()}
        for t, _, _ in data:
            mine = [(n, e) for u, n, e in data if 0 <= (t - u).total_seconds() < seconds]
            n, e = sum(x[0] for x in mine), sum(x[1] for x in mine)
            assert got[t] == pytest.approx(e / n if n else 0.0)


def test_minutes_are_dense(spark):
    rows_ = [(dt.datetime(2024, 1, 1, 23, 58, 30), "GET", "/x", "200", 0.1), (dt.datetime(2024, 1, 2, 0, 1), "GET", "/x", "503", 0.1), (dt.datetime(2024, 1, 2, 9), "GET", slo.SELF, "200", 0.1)]
    df = spark.createDataFrame(rows_, "ts timestamp, method string, path string, status string, duration double")
    assert [tuple(r)[1:] for r in slo.minutes(df).orderBy("bucket_ts").collect()] == [(1, 0), (0, 0), (0, 0), (1, 1)]
    assert slo.minutes(df.where("false")).count() == 0 and slo.alerts(df.where("false")).count() == 0


def test_events_are_one_to_the_second(spark):
    s = dt.datetime(2024, 1, 1, 1, 1, 1)
    data = [("a", "1", s, 1.0), ("a", "1", s + dt.timedelta(milliseconds=900), 2.0), ("a", "1", s + dt.timedelta(seconds=1), 3.0), ("a", "2", s, 4.0), (None, "1", s, None), (None, "1", s, None)]
    got = final.final_events(spark.createDataFrame(data, "tenant_id string, event_id string, occurred_at timestamp, value double"))
    assert rows(got, "tenant_id", "event_id", "value") == sorted([("a", "1", 2.0), ("a", "1", 3.0), ("a", "2", 4.0), (None, "1", None)], key=repr)


def test_amounts_add_up_whatever_the_order(spark):
    a = spark.createDataFrame([("k", 1, 0.1), ("k", 1, 0.2)], "key string, n long, v double")
    b = spark.createDataFrame([("k", 1, 0.3), ("m", 2, None)], "key string, n long, v double")
    assert rows(final.upsert_add(a, b, ["key"], ["n", "v"])) == rows(final.upsert_add(b, a, ["key"], ["n", "v"])) == [("k", 3, 0.6), ("m", 2, 0.0)]
