"""Erasure, anonymisation, export and consent of a tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions.scalar import mask_pii, stream_name
from driftline.schemas import CASCADE


def erase(tables: dict[str, DataFrame], tenant: str) -> dict[str, DataFrame]:
    """All tables without the tenant: its row, its log stream, its windows, and every table that hangs on it.

    Audit entries, projection positions and idempotency keys stay. Raises if there is no such tenant.
    """
    if tables["tenants"].where(F.col("id") == tenant).isEmpty():
        raise LookupError(f"no tenant {tenant}")
    out = {}
    for name, df in tables.items():
        if name == "tenants":
            df = df.where(~F.col("id").eqNullSafe(tenant))
        elif name == "event_log":
            df = df.where(~F.col("stream_name").eqNullSafe(f"tenant-{tenant}"))
        elif name in CASCADE or name == "tenant_window_stats":
            df = df.where(~F.col("tenant_id").eqNullSafe(tenant))
        out[name] = df
    return out


def erase_many(child: DataFrame, erased: DataFrame, key: str = "tenant_id") -> DataFrame:
    """Rows of a child table whose tenant isn't among the erased ones."""
    return child.join(erased.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def swap(df: DataFrame, path: str) -> None:
    """Rewrite a table beside its place, then put it there."""
    df.write.mode("overwrite").parquet(path + ".new")
    scratch.move(df.sparkSession, path + ".new", path)


def anonymise_events(events: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """(events, counters): the tenant's payloads masked and all its unmasked rows marked; (scanned, anonymised) are equal."""
    mine = F.col("tenant_id").eqNullSafe(tenant) & ~F.coalesce("pii_erased", F.lit(False))
    counters = events.agg(F.count_if(mine).alias("scanned"), F.count_if(mine).alias("anonymised"))
    return events.withColumn("payload", F.when(mine, mask_pii("payload")).otherwise(F.col("payload"))).withColumn(
        "pii_erased", F.when(mine, True).otherwise(F.col("pii_erased"))), counters


def anonymise_log(log: DataFrame, tenant: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(log, counters): the data of the tenant's stream masked; only changed rows count as anonymised.

    By default only the payload inside data is masked, so that ids survive and read models can be
    rebuilt; ``whole`` masks all of data.
    """
    mine = F.col("stream_name").eqNullSafe(stream_name(F.lit(tenant)))
    if whole:
        masked = mask_pii("data")
    else:
        d = F.from_json("data", "tenant_id string, event_type string, payload string, value double, id string")
        masked = F.to_json(F.struct(d["tenant_id"].alias("tenant_id"), d["event_type"].alias("event_type"), mask_pii(d["payload"]).alias("payload"),
                                    d["value"].alias("value"), d["id"].alias("id")))
    changed = mine & (masked != F.col("data"))
    counters = log.agg(F.count_if(mine).alias("scanned"), F.count_if(changed).alias("anonymised"))
    return log.withColumn("data", F.when(changed, masked).otherwise(F.col("data"))), counters


def export(tenants: DataFrame, events: DataFrame, consents: DataFrame, tenant: str) -> DataFrame:
    """Portability document: (part, seq, json) lines of the tenant, its events by time, its consents.

    Lines rather than one value, as a tenant's events have no bound.
    """
    head = tenants.where(F.col("id") == tenant).select(F.lit("tenant").alias("part"), F.lit(0).cast("timestamp").alias("at"), F.to_json(F.struct("*")).alias("json"))
    ev = events.where(F.col("tenant_id") == tenant).select(F.lit("event").alias("part"), F.col("occurred_at").alias("at"), F.to_json(F.struct("*")).alias("json"))
    co = consents.where(F.col("tenant_id") == tenant).select(F.lit("consent").alias("part"), F.lit(0).cast("timestamp").alias("at"), F.to_json(F.struct("*")).alias("json"))
    rank = F.when(F.col("part") == "tenant", 0).when(F.col("part") == "event", 1).otherwise(2)
    return head.unionByName(ev).unionByName(co).orderBy(rank, "at", "json")


def export_summary(events: DataFrame, tenant: str) -> DataFrame:
    return events.where(F.col("tenant_id") == tenant).groupBy("tenant_id").agg(
        F.count("*").alias("n_events"), F.min("occurred_at").alias("first_ts"), F.max("occurred_at").alias("last_ts"))


def consent(changes: DataFrame) -> DataFrame:
    """Current consent from a log of (tenant_id, purpose, action, seq): state 1 granted, 2 revoked.

    A revoke before any grant does nothing; without a row the state is 0 (see :func:`consent_state`). Once there is
    a grant, the last action decides: a revoke that comes last comes after it.
    """
    last = changes.groupBy("tenant_id", "purpose").agg(
        F.min(F.when(F.col("action") == "grant", F.col("seq"))).alias("granted"), F.max(F.struct("seq", "action")).alias("last"))
    return last.where("granted IS NOT NULL").select("tenant_id", "purpose", F.when(F.col("last.action") == "grant", 1).otherwise(2).alias("state"))


def consent_state(keys: DataFrame, current: DataFrame) -> DataFrame:
    return keys.join(current, ["tenant_id", "purpose"], "left").withColumn("state", F.coalesce("state", F.lit(0)))


def gate(df: DataFrame, current: DataFrame, purpose: str) -> DataFrame:
    """Rows of tenants that haven't revoked the purpose; no record passes."""
    return df.join(current.where((F.col("purpose") == purpose) & (F.col("state") == 2)).select("tenant_id"), "tenant_id", "left_anti")
