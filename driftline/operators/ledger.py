"""Prepaid credit and the outbox of charges."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import limit_or
from driftline.operators.final import latest


def balances(tenants: DataFrame, changes: DataFrame) -> DataFrame:
    """(tenant_id, balance_cents): the sum of a tenant's changes; a tenant without any has 0."""
    got = changes.groupBy("tenant_id").agg(F.sum("amount_cents").alias("balance_cents"))
    return tenants.select(F.col("id").alias("tenant_id")).join(got, "tenant_id", "left").withColumn("balance_cents", F.coalesce("balance_cents", F.lit(0)))


CHUNK = 10_000


def charge(opening: DataFrame, charges: DataFrame) -> DataFrame:
    """Each tenant's charges in order, taken only if the balance covers them and the idempotency key is new.

    (tenant_id, accepted, rejected, replayed, balance_cents). ``charges``: tenant_id, seq, idempotency_key,
    amount_cents (above 0). The fold is sequential per tenant by nature; a tenant's charges stream through
    one task in Arrow batches, sorted by the shuffle, and only its balance and keys are held.
    """
    joined = charges.join(opening.withColumnRenamed("tenant_id", "__t"), F.col("tenant_id") == F.col("__t"), "left").select(
        "tenant_id", "seq", "idempotency_key", "amount_cents", F.coalesce("balance_cents", F.lit(0)).alias("opening"))

    def fold(batches):
        tenant, balance, counts, keys = None, 0, [0, 0, 0], set()
        for b in batches:
            out = []
            for t, key, amount, start in zip(b["tenant_id"], b["idempotency_key"], b["amount_cents"], b["opening"]):
                if t != tenant:
                    if tenant is not None:
                        out.append((tenant, *counts, balance))
                    tenant, balance, counts, keys = t, int(start), [0, 0, 0], set()
                if key in keys:
                    counts[2] += 1
                elif amount <= 0 or amount > balance:
                    counts[1] += 1
                else:
                    balance -= int(amount)
                    counts[0] += 1
                    keys.add(key)
            yield pd.DataFrame(out, columns=["tenant_id", "accepted", "rejected", "replayed", "balance_cents"])
        if tenant is not None:
            yield pd.DataFrame([(tenant, *counts, balance)], columns=["tenant_id", "accepted", "rejected", "replayed", "balance_cents"])

    return joined.repartition("tenant_id").sortWithinPartitions("tenant_id", "seq").mapInPandas(
        fold, "tenant_id string, accepted long, rejected long, replayed long, balance_cents long")


def pending(records: DataFrame, limit: int | None = None) -> DataFrame:
    """The oldest unsent records."""
    return records.where("outbox_sent_at IS NULL").orderBy("created_at", "id").limit(limit_or(limit, 100, 10_000))


def mark_sent(records: DataFrame, sent: DataFrame) -> DataFrame:
    """Records with the sending times of (id, outbox_sent_at); the first stands."""
    return records.join(sent.groupBy("id").agg(F.min("outbox_sent_at").alias("__s")), "id", "left").withColumn(
        "outbox_sent_at", F.coalesce("outbox_sent_at", "__s")).drop("__s").select(*records.columns)


def publish(records: DataFrame, send: Callable[[DataFrame], DataFrame], at) -> DataFrame:
    """One sweep of the outbox: ``send`` takes the pending rows and returns the ids that got through.

    A row that fails stays pending and holds up no other. At least once: marking comes after sending.
    """
    ok = send(pending(records)).select("id").distinct()
    return mark_sent(records, ok.withColumn("outbox_sent_at", F.lit(at)))


def current(records: DataFrame) -> DataFrame:
    """Latest version of each record of an append-only billing table (column version)."""
    return latest(records, ["id"], ["version"])
