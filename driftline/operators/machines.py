"""Per-key state machines over ordered logs.

Those that need only a running maximum or a first row are windows; those whose next state depends on what was
decided before (token bucket, breaker) are folds that stream a key's rows through one task in order and hold a
few numbers per key.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import scratch
from driftline.operators.joins import lookup_join


def running_max(df: DataFrame, order: str, value: str, out: str, before: bool = True, key: list[str] | None = None) -> DataFrame:
    """``out``: greatest ``value`` of earlier rows (with the row itself if not ``before``).

    Per key a window does it. Over the whole table, rows are range-partitioned, each partition's
    maximum is one number, and the windows run inside the partitions.
    """
    frame = (Window.unboundedPreceding, -1 if before else 0)
    if key:
        return df.withColumn(out, F.max(value).over(Window.partitionBy(*key).orderBy(order).rowsBetween(*frame)))
    placed = scratch.table(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "running-max")
    tops = {r["__p"]: r["m"] for r in placed.groupBy("__p").agg(F.max(value).alias("m"), F.min(order).alias("o")).collect()}
    so_far, starts = None, []
    for p in sorted(tops):
        starts.append((p, so_far))
        so_far = tops[p] if so_far is None else so_far if tops[p] is None else max(so_far, tops[p])
    kind = df.schema[value].dataType.simpleString()
    offsets = df.sparkSession.createDataFrame(starts, f"p int, top {kind}")
    inside = F.max(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(*frame))
    return placed.join(F.broadcast(offsets), F.col("__p") == F.col("p")).withColumn(out, F.greatest("top", inside)).drop("__p", "p", "top")


def fencing(writes: DataFrame, order: str = "event_id", token: str = "token", key: list[str] | None = None) -> DataFrame:
    """A write is accepted if its token is greater than all before it (0 at first)."""
    got = running_max(writes, order, token, "__top", key=key)
    return got.withColumn("accepted", F.col(token) > F.coalesce("__top", F.lit(0))).drop("__top")


def reservations(requests: DataFrame) -> DataFrame:
    """Per idempotency key (ns_key, seq, fingerprint): the first request wins; later ones are replays of it if their
    fingerprint is the same, else conflicts. (ns_key, winner_id, seq, outcome).

    The first of each key is an aggregate, which also counts the key's requests; requests find it by a join that
    spreads the hot keys only.
    """
    first = requests.groupBy("ns_key").agg(F.min(F.struct("seq", "fingerprint")).alias("f"), F.count("*").alias("__n")).select(
        "ns_key", F.col("f.seq").alias("winner_id"), F.col("f.fingerprint").alias("print"), "__n")
    got = lookup_join(requests, scratch.table(first, "reservations"), ["ns_key"], salt_by="seq", rows_of="__n")
    return got.withColumn("outcome", F.when(F.col("seq") == F.col("winner_id"), "reserved").when(
        F.col("fingerprint").eqNullSafe(F.col("print")), "replay").otherwise("reused")).drop("print", "__n")


def expired(keys: DataFrame, now, completed: str = "INTERVAL 24 HOURS", in_flight: str = "INTERVAL 5 MINUTES") -> DataFrame:
    """Keys a cleanup removes."""
    t = F.lit(now).cast("timestamp")
    return keys.where(((F.col("state") == "completed") & (F.col("created_at") < t - F.expr(completed)))
                      | ((F.col("state") == "in_flight") & (F.col("created_at") < t - F.expr(in_flight))))


def _fold(df: DataFrame, key: str, order: str, columns: list[str], schema: str, start: Callable, step: Callable) -> DataFrame:
    """Stream each key's rows in order through ``step(state, row) -> output``; state is made by ``start(row)``."""
    def run(batches):
        at, state = object(), None
        for b in batches:
            out = []
            for row in b[[key, order, *columns]].itertuples(index=False, name=None):
                if row[0] != at:
                    at, state = row[0], start(row)
                out.append((row[0], row[1], *step(state, row)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return df.select(key, order, *columns).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def idempotency(requests: DataFrame, key: str = "ns_key", at: str = "at_s", completed_for: float = 86_400.0, in_flight_for: float = 300.0) -> DataFrame:
    """(ns_key, at_s, outcome) of each request: reserved, replay, in_progress or reused.

    Columns fingerprint, done_s (when the request it reserves for ends) and code (its status). A reservation is in flight until then:
    a 2xx completes it, any other code releases the key, as does ``in_flight_for`` seconds without an end. A completed key answers for
    ``completed_for`` seconds, then it is as if it weren't there. Another fingerprint under a held key is reused; ties in time go in no set order.
    """
    def start(row):
        return {"held": False}

    def step(s, row):
        _, now, print_, done, code = row
        if s["held"] and not s["complete"] and now >= min(s["done"], s["since"] + in_flight_for):
            if s["done"] <= s["since"] + in_flight_for and 200 <= s["code"] < 300:
                s.update(complete=True, since=s["done"])
            else:
                s["held"] = False
        if s["held"] and s["complete"] and now >= s["since"] + completed_for:
            s["held"] = False
        if not s["held"]:
            s.update(held=True, complete=False, print=print_, since=now, done=done, code=code)
            return ("reserved",)
        if s["print"] != print_:
            return ("reused",)
        return ("replay" if s["complete"] else "in_progress",)

    return _fold(requests, key, at, ["fingerprint", "done_s", "code"], "ns_key string, at_s double, outcome string", start, step)


def token_bucket(requests: DataFrame, key: str = "key", at: str = "at_s", rate: str = "rate", burst: str = "burst") -> DataFrame:
    """(key, at, allowed, retry_after_s, remaining): a bucket per key refills at ``rate`` a second to ``burst``.

    Rate and burst may change from request to request: tokens held are kept (at most the new burst). A
    refused request takes nothing.
    """
    def start(row):
        return {"t": row[1], "tokens": float(row[3])}

    def step(s, row):
        _, now, r, b = row
        s["tokens"] = min(float(b), s["tokens"] + max(0.0, now - s["t"]) * r)
        s["t"] = max(s["t"], now)
        if s["tokens"] >= 1.0:
            s["tokens"] -= 1.0
            return True, 0.0, int(s["tokens"])
        return False, (1.0 - s["tokens"]) / r if r else float("inf"), int(s["tokens"])

    return _fold(requests, key, at, [rate, burst], "key string, at_s double, allowed boolean, retry_after_s double, remaining long", start, step)


def breaker(calls: DataFrame, key: str = "key", at: str = "at_s", failures: int = 5, interval: float = 10.0, open_for: float = 30.0, probes: int = 3) -> DataFrame:
    """(key, at, state, allowed): a breaker per operation over logged outcomes (column ok).

    Closed: ``failures`` consecutive failures open it; counts start anew every ``interval`` seconds. Open:
    calls are refused for ``open_for`` seconds. Half-open: ``probes`` successes close it, a failure reopens it.
    """
    def start(row):
        return {"state": "closed", "fails": 0, "since": row[1], "good": 0}

    def step(s, row):
        _, now, ok = row
        if s["state"] == "open" and now - s["since"] >= open_for:
            s.update(state="half_open", good=0)
        if s["state"] == "closed" and now - s["since"] >= interval:
            s.update(fails=0, since=now)
        before = s["state"]
        if before == "open":
            return before, False
        if ok:
            s["fails"] = 0
            s["good"] += 1
            if before == "half_open" and s["good"] >= probes:
                s.update(state="closed", since=now)
        else:
            s["fails"] += 1
            if before == "half_open" or s["fails"] >= failures:
                s.update(state="open", since=now, fails=0)
        return before, True

    return _fold(calls, key, at, ["ok"], "key string, at_s double, state string, allowed boolean", start, step)


def transitions(states: DataFrame, key: str = "key", at: str = "at_s") -> DataFrame:
    w = Window.partitionBy(key).orderBy(at)
    return states.withColumn("was", F.lag("state").over(w)).where("was <> state").select(key, at, F.col("was").alias("from_state"), F.col("state").alias("to_state"))


def required_lsn(request_floor, watermark) -> Column:
    """A request's own floor beats the pool's watermark, even if lower; 0 is no floor."""
    return F.coalesce(F.nullif(request_floor, F.lit(0)), watermark)


def route(required, replay) -> Column:
    """Whether the replica is fresh enough."""
    return replay >= required
