import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.operators import projections, windows
from driftline.sources import event_log, fixtures, topic
from driftline.streaming import consumer
from driftline.streaming import projections as follow
from driftline.streaming import windows as streaming
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
COLS = ("tenant_id", "event_type", "window_start", "event_count", "sum_value")


@pytest.fixture(scope="module")
def parts(spark):
    a = fixtures.arrivals(spark, SF)
    again = a.where("event_id % 10 = 0").withColumn("delivery_id", F.col("delivery_id") + 1_000_000)
    a = a.unionByName(again)
    cuts = a.agg(F.percentile_approx(F.unix_micros("received_at"), [0.3, 0.7]).alias("c")).first()["c"]
    us = F.unix_micros("received_at")
    return a, [a.where(us <= cuts[0]), a.where((us > cuts[0]) & (us <= cuts[1])), a.where(us > cuts[1])]


def test_stream_equals_batch_also_when_a_batch_comes_again(spark, parts, tmp_path):
    whole, pieces = parts
    ws = streaming.WindowStream(spark, f"file://{tmp_path}/w", (3600,))
    for i, p in enumerate(pieces):
        ws.process(p, i)
        if i == 1:
            ws.process(p, i)
    marked = windows.first_deliveries(windows.with_watermark(whole), 3600)
    assert rows(ws.state(3600).where("NOT is_late"), *COLS) == rows(windows.tumbling(marked, 3600), *COLS)
    assert rows(ws.state(3600).where("is_late"), "tenant_id", "event_count") == rows(windows.late_bucket(marked, 3600), "tenant_id", "event_count")
    closed = rows(windows.history(marked, 3600).where("NOT is_late"), *COLS)
    assert rows(ws.flushed(3600).where("NOT is_late"), *COLS) == closed
    assert ws.live(3600).count() >= 0


def test_native_windows_run(spark, parts, tmp_path):
    parts[1][0].write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in")
    q = streaming.native(stream, "1 hour").writeStream.format("memory").queryName("native").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("native").count() > 0


def test_topic_dead_letters_and_retries(spark, tmp_path):
    path = f"{tmp_path}/topic"
    ev = fixtures.events(spark, SF).limit(20)
    topic.publish(topic.messages(ev, ["occurred_at"]), path)
    topic.publish(spark.createDataFrame([(b"k", b"\x0a\x09x", {"a": "b"})], "key binary, value binary, headers map<string,string>"), path)
    calls, seen = [], []

    def handler(good, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("not yet")
        seen.extend(r.event_id for r in good.collect())

    consumer.consume(spark, path, handler, f"{tmp_path}/c", f"{tmp_path}/dlq")
    assert sorted(seen) == sorted(str(r.event_id) for r in ev.collect())
    dead = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/dlq").collect()
    assert [(bytes(d.value), d.reason) for d in dead] == [(b"\x0a\x09x", "unmarshal_failed")]

    def broken(good, batch_id):
        raise RuntimeError("never")

    consumer.handle(spark.read.parquet(path), 9, broken, path, f"{tmp_path}/dlq2", base_s=0.0)
    failed = spark.read.parquet(f"{tmp_path}/dlq2/failed/batch=9")
    assert failed.count() == 21 and failed.first().attempts == 3
    consumer.handle(spark.read.parquet(path), 9, broken, path, None, base_s=0.0)


def test_projection_follows_the_log(spark, tmp_path):
    log, root = f"file://{tmp_path}/log", f"file://{tmp_path}/p"
    ev = fixtures.events(spark, SF)
    event_log.append(ev.where("event_id < 300"), log)
    p = projections.DailyCounts()
    follow.follow(spark, log, p, root)
    assert p.position(spark, root) == 300
    event_log.append(ev.where("event_id >= 300 AND event_id < 500"), log)
    follow.follow(spark, log, p, root)
    assert p.position(spark, root) == 500
    assert rows(p.state(spark, root), "tenant_id", "event_date", "event_count") == rows(p.transform(event_log.read(spark, log)), "tenant_id", "event_date", "event_count")


def test_state_is_merged_and_expires(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "MERGE_EVERY", 3)
    a = fixtures.arrivals(spark, SF).where("tenant_id < '2'")
    us = F.unix_micros("received_at")
    cuts = a.agg(F.percentile_approx(us, [0.2, 0.4, 0.6, 0.8]).alias("c")).first()["c"]
    edges = [0, *cuts, 1 << 62]
    pieces = [a.where((us > low) & (us <= high)) for low, high in zip(edges, edges[1:])]
    ws = streaming.WindowStream(spark, f"file://{tmp_path}/w", (3600,))
    now = dt.datetime(2024, 1, 1, 5, 30, tzinfo=dt.timezone.utc)
    assert ws.frames(3600, now).count() == 0
    for i in (0, 1, 2, 2, 3, 4):  # the third comes again after what was before it has been merged
        ws.process(pieces[i], i)
    ws.sweep()
    ws.sweep()
    marked = windows.first_deliveries(windows.with_watermark(a), 3600)
    want = windows.history(marked, 3600)
    assert rows(ws.history().where("NOT is_late"), *COLS) == rows(want.where("NOT is_late"), *COLS)
    late = ("tenant_id", "event_type", "event_count", "sum_value")
    assert rows(ws.history().where("is_late"), *late) == rows(want.where("is_late"), *late)
    assert ws.state(3600).where("NOT is_late").count() < want.where("NOT is_late").count()  # old windows are in history only
    kept = {p.name for p in (tmp_path / "w" / "applied" / "duration=1h").iterdir() if p.name.startswith("period=w")}
    assert 0 < len(kept) < want.where("NOT is_late").select("window_start").distinct().count()
    assert {r.based_on for r in ws.frames(3600, now).collect()} == {"watermark"}


def test_only_failed_events_are_retried_and_become_dead_letters(spark, tmp_path):
    path = f"{tmp_path}/topic"
    ev = fixtures.events(spark, SF).limit(20)
    topic.publish(topic.messages(ev, ["occurred_at"]), path)
    bad = sorted(str(r.event_id) for r in ev.limit(3).collect())
    given = []

    def handler(events, batch_id):
        given.append((batch_id, sorted(r.event_id for r in events.collect())))
        return events.where(F.col("event_id").isin(bad)).select("event_id", F.lit("poison").alias("last_error"))

    consumer.handle(topic.located(spark.read.parquet(path)), 4, handler, path, f"{tmp_path}/dlq", base_s=0.0)
    assert [b for b, _ in given] == [4, "4.2", "4.3"] and len(given[0][1]) == 20 and given[1][1] == given[2][1] == bad
    dead = spark.read.parquet(f"{tmp_path}/dlq/failed/batch=4")
    assert dead.count() == 3 and dead.where("last_error <> 'poison' OR original_partition IS NULL OR original_offset IS NULL OR attempts <> 3").isEmpty()
    back, _ = topic.decoded(dead)
    assert sorted(r.event_id for r in back.collect()) == bad
    headers = topic.dead_messages(dead).first().headers
    assert set(headers) == {"original_topic", "original_partition", "original_offset", "reason", "attempts", "last_error", "failed_at"}
