import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from driftline.operators import features, trailing
from driftline.plans import core
from tests.conftest import rows

T0 = dt.datetime(2025, 5, 1)
EV = "tenant_id string, event_type string, value double, occurred_at timestamp, n int, entity string, day string"


def ev(tenant, kind, value, hours):
    return (tenant, kind, value, None if hours is None else T0 + dt.timedelta(hours=hours), 1, "clash", "clash")


DATA = [ev("a", "x", 1.5, 0), ev("a", "x", 2.5, 30), ev("a", None, None, 31), ev("a", "", float("nan"), 31), ev("b", "x", -1.0, 50), ev(None, "y", 1.0, 50), ev("c", "z", 9.0, None),
        ev("a", "x", 2.5, 30)]


def test_features(spark):
    store = features.FeatureStore(spark)
    store.load(spark.createDataFrame(DATA, EV))
    got = {r.entity: r for r in store.features(T0 + dt.timedelta(hours=60)).collect()}
    assert set(got) == {"a", "b", None}
    assert got["a"].counts == {"x": 3, "(null)": 1, "": 1}
    assert got["a"].totals == {"x": 6.5, "(null)": 0.0, "": 0.0}
    assert got["a"].recency_s["x"] == 30 * 3600
    wide = features.as_columns(store.features(T0 + dt.timedelta(hours=60)), ["x", "nope"]).where("entity = 'b'").first()
    assert (wide["x__count"], wide["x__total"], wide["nope__count"], wide["nope__recency_s"]) == (1, -1.0, 0, None)


def test_only_changed_days_are_recomputed(spark):
    store = features.FeatureStore(spark)
    store.load(spark.createDataFrame(DATA, EV))
    before = {p for p in rows(store.buckets().select("_metadata.file_path", "day"))}
    arrived = spark.createDataFrame([ev("b", "x", 4.0, 49)], EV)
    days = store.changed_days(arrived)
    assert days == [dt.date(2025, 5, 3)]
    everything = spark.createDataFrame([*DATA, ev("b", "x", 4.0, 49)], EV)
    store.load(everything, days)
    after = {p for p in rows(store.buckets().select("_metadata.file_path", "day"))}
    assert {p for p in before if p[1] != days[0]} == {p for p in after if p[1] != days[0]}
    full = features.FeatureStore(spark)
    full.load(everything)
    now = T0 + dt.timedelta(hours=60)
    assert rows(store.by_type(now)) == rows(full.by_type(now))


def test_edges_of_a_span_come_from_the_events(spark):
    events = spark.createDataFrame(DATA, EV)
    store = features.FeatureStore(spark)
    store.load(events)
    got = rows(store.by_type(T0 + dt.timedelta(hours=30), T0 + dt.timedelta(hours=1), events), "entity", "event_type", "n")
    assert got == [("a", "x", 2)]


def test_queries_load_changed_days_only(spark, monkeypatch):
    received = "tenant_id string, event_type string, value double, occurred_at timestamp, received_at timestamp"
    data = [(f"t{i % 3}", "x", float(i), T0 + dt.timedelta(hours=7 * i), T0 + dt.timedelta(hours=7 * i, minutes=1)) for i in range(40)]
    loaded, load = [], features.FeatureStore.load
    monkeypatch.setattr(features.FeatureStore, "load", lambda self, events, days=None: (loaded.append(days), load(self, events, days))[1])
    monkeypatch.setattr(core, "read", lambda spark, d, t: spark.createDataFrame(data, received))
    got = rows(core.p6_by_type(spark, ""), "tenant_id", "event_count", "total_value")
    assert got == [(f"t{k}", len(range(k, 40, 3)), float(sum(range(k, 40, 3)))) for k in range(3)]
    assert loaded[0] is None and 0 < len(loaded[1]) < 4
    monkeypatch.setattr(core, "read", lambda spark, d, t: spark.createDataFrame([], received))
    assert core.p6_features(spark, "").count() == 0


def test_no_events(spark):
    store = features.FeatureStore(spark)
    store.load(spark.createDataFrame([], EV))
    assert store.features(T0).count() == 0


ST = "tenant_id string, event_type string, date date, event_count long, total_value double, inserted_at timestamp, n int, day string"


def brute(valid):
    """valid: {tenant: {day: (n, v)}}"""
    out = {}
    for t, days in valid.items():
        active = [d for d, (n, _) in days.items() if n > 0]
        if not active:
            continue
        d = min(active)
        while d <= max(active):
            for s in (7, 30):
                span = [days.get(d - dt.timedelta(days=k), (0, Decimal(0))) for k in range(s) if d - dt.timedelta(days=k) >= min(active)]
                out[t, d, s] = (sum(x[0] for x in span), float(sum(x[1] for x in span)))
            d += dt.timedelta(days=1)
    return out


def test_trailing_matches_brute_force_and_corrections(spark):
    random.seed(2)
    d0 = dt.date(2025, 3, 1)
    data, valid = [], {}
    for t in ("a", "b", "quiet"):
        for k in range(60):
            if random.random() < 0.25 or t == "quiet":
                n, v = (0 if t == "quiet" else random.randint(0, 5)), round(random.uniform(-9, 9), 2)
                data.append((t, "x", d0 + dt.timedelta(days=k), n + 1, 100.0, T0, 1, "c"))
                data.append((t, "x", d0 + dt.timedelta(days=k), n, v, T0 + dt.timedelta(hours=1), 1, "c"))
                data.append((t, "x", d0 + dt.timedelta(days=k), n, v, T0 + dt.timedelta(hours=1), 1, "c"))
                valid.setdefault(t, {})[d0 + dt.timedelta(days=k)] = (n, Decimal(str(v)))
    data += [("nulls", None, d0, 2, None, None, 1, "c"), (None, "x", d0, 2, 1.0, T0, 1, "c"), ("nulls", None, None, 2, 1.0, T0, 1, "c")]
    valid["nulls"] = {d0: (2, Decimal(0))}
    daily = trailing.daily(spark.createDataFrame(data, ST))
    state = trailing.build(daily)
    got = {(r.entity, r.day, r.span): (r.event_count, r.total_value) for r in trailing.long_form(state).collect()}
    want = brute(valid)
    # Before the first active day amounts may exist without activity; they don't count.
    assert set(got) == set(want)
    assert {k: (v[0], round(v[1], 4)) for k, v in got.items()} == {k: (v[0], round(v[1], 4)) for k, v in want.items()}

    days = sorted(d for (t, d, s) in got if t == "a" and s == 7)
    hit = days[len(days) // 2]
    changed = spark.createDataFrame([("a", hit, 50, Decimal("7.5"))], "entity string, day date, n long, v decimal(38,4)")
    fixed = trailing.correct(state, changed)
    redo = trailing.build(daily.where(~((F.col("entity") == "a") & (F.col("day") == F.lit(hit)))).unionByName(changed))
    cols = ["entity", "day", "n", "v", "n_7", "v_7", "n_30", "v_30"]
    assert rows(fixed, *cols) == rows(redo, *cols)
    touched = fixed.where("version = 2").agg(F.min("day"), F.max("day"), F.count("*")).first()
    assert touched[0] == hit and touched[1] == min(days[-1], hit + dt.timedelta(days=29))

    last = max(days)
    step = trailing.advance(state.where(F.col("day") < F.lit(last)), daily.where(F.col("day") == F.lit(last)), last.isoformat())
    assert rows(step.where("entity = 'a'"), *cols) == rows(state.where((F.col("entity") == "a") & (F.col("day") == F.lit(last))), *cols)


def test_store_equals_a_rebuild_after_every_batch(spark, tmp_path):
    random.seed(8)
    d0, sent = dt.date(2025, 3, 1), []
    store = trailing.TrailingStore(spark, f"file://{tmp_path}/t")
    cols = ["entity", "day", "n", "v", "n_7", "v_7", "n_30", "v_30"]
    for batch in range(5):
        new = []
        for _ in range(30):  # any day: new ones, corrections, before the first and after the last, to zero and back
            k, n = random.randint(max(0, 20 - 10 * batch), 30 + 20 * batch), random.choice([0, 0, 1, 3, 7])
            at = T0 + dt.timedelta(hours=batch if random.random() < 0.8 else batch - 2, seconds=len(new))
            new.append((random.choice("abc"), random.choice(["x", None]), d0 + dt.timedelta(days=k), n, random.choice([None, 1.25, -3.5]), at, 1, "c"))
        if batch == 3:  # an entity that is no longer active at all, and one whose last days go
            new += [(t, e, d0 + dt.timedelta(days=k), 0, 0.5, T0 + dt.timedelta(hours=9), 1, "c") for t, first in (("c", 0), ("b", 50)) for e in ("x", None) for k in range(first, 120)]
        sent += new
        if batch == 4:
            store = trailing.TrailingStore(spark, f"file://{tmp_path}/t")  # opened again
        store.apply(spark.createDataFrame(new, ST))
        assert rows(store.state(), *cols) == rows(trailing.build(trailing.daily(spark.createDataFrame(sent, ST))), *cols)
    assert store.version == 5 and store.state().where("version < 5").count() > 0  # rows that no change reached stay as they were


def test_nothing_to_apply(spark):
    store = trailing.TrailingStore(spark)
    store.apply(spark.createDataFrame([], ST))
    assert store.state().count() == 0


def test_no_stats(spark):
    assert trailing.long_form(trailing.build(trailing.daily(spark.createDataFrame([], ST)))).count() == 0
