import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.operators import late_events
from driftline.operators.message_store import MessageStore, canonical_uuid
from driftline.plans import core
from tests.conftest import rows

T0 = dt.datetime(2025, 5, 5)
U = "0a1b2c3d-1111-2222-3333-444455556666"
MSG = "delivery_id long, event_id string, tenant_id string, occurred_at timestamp, batch_id long, received_at timestamp, k string, copies int"


def msg(i, event_id, tenant="a", at=0, batch=1):
    return (i, event_id, tenant, T0, batch, T0 + dt.timedelta(seconds=at), "clash", 9)


def test_notations_of_one_uuid(spark):
    raw = [U, U.upper(), "{" + U + "}", "urn:uuid:" + U, U.replace("-", ""), f"  {U} ", "Other-ID", None, ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(canonical_uuid(F.col("x"))).collect()]
    assert got == [U] * 6 + ["other-id", None, ""]


def test_one_row_of_each_message(spark):
    data = [msg(1, U, at=9), msg(2, U.upper(), at=3), msg(3, "{" + U + "}", at=3), msg(4, U, tenant="b"), msg(5, "x1"), msg(6, " X1 "),
            msg(7, None), msg(8, None), msg(9, U, tenant=None), msg(10, U, tenant=None), msg(11, "", at=1)]
    store = MessageStore(spark, buckets=4)
    store.upsert(spark.createDataFrame(data, MSG), "b1")
    got = rows(store.messages(), "tenant_id", "event_id", "delivery_id", "copies")
    assert got == sorted([("a", U, 2, 3), ("b", U, 4, 1), ("a", "x1", 5, 2), ("a", None, 7, 1), ("a", None, 8, 1), (None, U, 9, 1), (None, U, 10, 1), ("a", "", 11, 1)], key=repr)


def test_upserts_are_idempotent_and_runs_merge(spark):
    a = spark.createDataFrame([msg(1, U, at=5), msg(2, "y")], MSG)
    b = spark.createDataFrame([msg(3, U, at=1), msg(4, "z")], MSG)
    store = MessageStore(spark, buckets=4)
    store.upsert(a, "one")
    store.upsert(b, "two")
    store.upsert(b, "two")
    want = sorted([("a", U, 3, 2), ("a", "y", 2, 1), ("a", "z", 4, 1)], key=repr)
    assert rows(store.messages(), "tenant_id", "event_id", "delivery_id", "copies") == want
    store.compact()
    assert len(store.runs) == 1
    assert rows(store.messages(), "tenant_id", "event_id", "delivery_id", "copies") == want
    store.upsert(spark.createDataFrame([msg(5, "y", at=0)], MSG), "three")
    assert ("a", "y", 2, 2) in rows(store.messages(), "tenant_id", "event_id", "delivery_id", "copies")


COUNTED = ("tenant_id", "event_id", "delivery_id", "copies")


def test_a_store_is_opened_again_and_merged_batches_count_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    a, b = (spark.createDataFrame(x, MSG) for x in ([msg(1, U, at=5), msg(2, "y")], [msg(3, U, at=1), msg(4, "z")]))
    first = MessageStore(spark, path, buckets=4)
    first.upsert(a, "one")
    first.close()
    again = MessageStore(spark, path)
    assert again.buckets == 4 and list(again.runs.values()) == [["one"]]
    again.upsert(b, "two")
    want = sorted([("a", U, 3, 2), ("a", "y", 2, 1), ("a", "z", 4, 1)], key=repr)
    assert rows(MessageStore(spark, path).messages(), *COUNTED) == want
    again.compact()
    again.upsert(a, "one")
    again.upsert(b, "two")
    assert rows(MessageStore(spark, path).messages(), *COUNTED) == want


def test_a_crash_leaves_what_was_committed(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    a, b = (spark.createDataFrame(x, MSG) for x in ([msg(1, U, at=5)], [msg(3, U, at=1), msg(4, "z")]))
    store = MessageStore(spark, path, buckets=4)
    store.upsert(a, "one")
    store.upsert(b, "two")
    want = rows(store.messages(), *COUNTED)

    def crash(self, runs):
        raise RuntimeError("crash")

    for step in (lambda s: s.compact(), lambda s: s.upsert(a, "one"), lambda s: s.upsert(b, "three")):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(MessageStore, "_commit", crash)
            step(MessageStore(spark, path))
        assert rows(MessageStore(spark, path).messages(), *COUNTED) == want
    after = MessageStore(spark, path)
    after.compact()
    assert rows(after.messages(), *COUNTED) == want
    assert len(list((tmp_path / "store" / "runs").glob("run=*"))) == 1  # what no manifest names is gone


def test_a_run_takes_one_exchange_and_a_file_per_bucket(spark, tmp_path):
    store = MessageStore(spark, f"file://{tmp_path}/store", buckets=4)
    many = spark.range(400).select(F.col("id").alias("delivery_id"), F.concat(F.lit("m"), F.col("id") % 100).alias("event_id"), F.lit("a").alias("tenant_id"),
                                   F.lit(T0).alias("occurred_at"), F.lit(1).cast("long").alias("batch_id"), F.lit(T0).alias("received_at"))
    store.upsert(many, "one")
    assert len(list((tmp_path / "store" / "runs").glob("run=*/*.parquet"))) <= 4
    store.upsert(many, "two")
    assert "Exchange" not in store.messages()._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    store.compact()
    assert store.messages().agg(F.sum("copies"), F.count("*")).first()[:] == (800, 100)


def test_compacted_buckets_are_read_without_a_shuffle(spark):
    store = MessageStore(spark, buckets=4)
    store.upsert(spark.createDataFrame([msg(1, U)], MSG), "one")
    assert "Exchange" not in store.messages()._jdf.queryExecution().executedPlan().toString()


def test_no_messages(spark):
    store = MessageStore(spark)
    assert store.messages().count() == 0
    store.compact()
    store.upsert(spark.createDataFrame([], MSG), "empty")
    assert store.messages().count() == 0


def test_copies_of_different_runs_meet_in_the_queries(spark, monkeypatch):
    data = [msg(i, f"m{i % 20}", at=i) for i in range(80)] + [(99, "m0", "a", T0, 1, None, "clash", 9)]
    runs, compacted = [], []
    upsert, compact = MessageStore.upsert, MessageStore.compact
    monkeypatch.setattr(core, "read", lambda spark, d, t: spark.createDataFrame(data, MSG))
    monkeypatch.setattr(MessageStore, "upsert", lambda self, df, run: (runs.append({r.delivery_id for r in df.collect()}), upsert(self, df, run))[1])
    monkeypatch.setattr(MessageStore, "compact", lambda self: (compacted.append(len(self.runs)), compact(self))[1])
    got = rows(core.p4_messages(spark, ""), "event_id", "copies")
    assert got == sorted([(f"m{i}", 5 if i == 0 else 4) for i in range(20)], key=repr)
    assert len(runs) > 1 and compacted == [len(runs)] and sum(map(len, runs)) == len(set().union(*runs)) == 81
    monkeypatch.setattr(core, "read", lambda spark, d, t: spark.createDataFrame([], MSG))
    assert core.p4_messages(spark, "").count() == 0


LATE = "delivery_id long, tenant_id string, event_type string, value double, occurred_at timestamp, received_at timestamp, slot int, watermark int, fate string, block int"


def simulate(data):
    """data: (delivery_id, occurred second or None, received second)."""
    out, top = {}, None
    for i, o, _ in sorted(data, key=lambda x: (x[2], x[0])):
        if o is None or top is None or o >= top - 30:
            out[i] = "on_time"
        else:
            out[i] = "dropped" if o < top - 2 * 86400 else "corrects"
        if o is not None:
            top = o if top is None else max(top, o)
    return out


def frame(spark, data):
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    return spark.createDataFrame([(i, "t", "e", 1.0, at(o), at(r), 1, 2, "x", 3) for i, o, r in data], LATE)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 400_000)), st.integers(0, 200_000)), max_size=40), st.sampled_from([0, 1_000_000]))
def test_lateness_is_per_event_in_arrival_order(spark, pairs, hot_rows):
    data = [(i, o, r) for i, (o, r) in enumerate(pairs)]
    got = {r.delivery_id: r.fate for r in late_events.classify(frame(spark, data), hot_rows).collect()}
    assert got == simulate(data)


def test_hot_slots_are_split_and_no_window_holds_more_than_a_level(spark):
    # Every minute is hot: 40,000 rows in each of three microseconds, ids far apart in one of them.
    n = 120_000
    df = spark.range(n).select(
        (F.col("id") * F.when(F.col("id") % 3 == 0, 1 << 33).otherwise(1)).alias("delivery_id"), F.lit("t").alias("tenant_id"), F.lit("e").alias("event_type"), F.lit(1.0).alias("value"),
        F.timestamp_seconds((F.col("id") * 7919) % 300_000).alias("occurred_at"), F.timestamp_micros(F.lit(1_000_000_000_000_000) + F.col("id") % 3).alias("received_at"))
    level = len(late_events.LEVELS) - 1
    slots = late_events._slots(df, level)
    for k in range(1, level + 1):
        above = [f"p{i}" for i in range(k)]
        assert slots.select(*above, f"p{k}").distinct().groupBy(*above).count().agg(F.max("count")).first()[0] <= 65_536
    got = {r.delivery_id: r.fate for r in late_events.classify(df, 1000).collect()}
    want, top = {}, None
    for r in sorted(df.collect(), key=lambda r: (r.received_at, r.delivery_id)):
        behind = 0 if top is None else (top - r.occurred_at).total_seconds()
        want[r.delivery_id] = "dropped" if behind > 2 * 86400 else "corrects" if behind > 30 else "on_time"
        top = r.occurred_at if top is None else max(top, r.occurred_at)
    assert got == want


def test_boundaries(spark):
    data = [(1, 1000, 0), (2, 970, 1), (3, 969, 2), (4, 1060, 3), (5, 1060 - 2 * 86400, 4), (6, 1059 - 2 * 86400, 5), (7, 1060, 5)]
    got = {r.delivery_id: r.fate for r in late_events.classify(frame(spark, data)).collect()}
    assert got == {1: "on_time", 2: "on_time", 3: "corrects", 4: "on_time", 5: "corrects", 6: "dropped", 7: "on_time"}


def test_triangle(spark):
    h = 3600
    data = [(1, 0, 0), (2, 10, 20), (3, h + 5, h + 6), (4, 15, h + 7), (5, 20, 2 * h), (6, 3 * 86400, 3 * 86400), (7, 30, 3 * 86400 + 1)]
    got = rows(late_events.revisions(late_events.classify(frame(spark, data))), "period_start", "arrival_start", "revision", "event_count", "sum_value", "late_count", "is_final")
    at = lambda n: T0 + dt.timedelta(hours=n)
    assert got == sorted([(at(0), at(0), 1, 2, 2.0, 0, False), (at(0), at(1), 2, 3, 3.0, 1, False), (at(0), at(2), 3, 4, 4.0, 2, True), (at(1), at(1), 1, 1, 1.0, 0, True),
                          (at(72), at(72), 1, 1, 1.0, 0, True)], key=repr)


def test_nothing_arrived(spark):
    c = late_events.classify(frame(spark, []))
    assert late_events.late_rows(c).count() == 0
    assert late_events.revisions(c).count() == 0


@pytest.mark.parametrize("value", [float("nan"), None, 1e300])
def test_unusable_values_count_as_rows(spark, value):
    df = frame(spark, [(1, 0, 0)]).withColumn("value", F.lit(value).cast("double"))
    r = late_events.revisions(late_events.classify(df)).first()
    assert (r.event_count, r.sum_value) == (1, 0.0)
