"""Reading append-only storage: the latest version of each key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.ordered import exact_sum


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row per key, the one with the greatest version columns. Combined map-side, so a hot key is no hot task.

    Nulls in the version are oldest. Rows equal in key and version are one of them, by the rest of the
    row. Null is a key. Columns keep their names and order.
    """
    rest = [c for c in df.columns if c not in key and c not in version]
    got = df.groupBy(*key).agg(F.max(F.struct(*version, *rest)).alias("__r"))
    return got.select(*[F.col(c) if c in key else F.col("__r")[c].alias(c) for c in df.columns])


def final_events(df: DataFrame) -> DataFrame:
    """Redeliveries collapsed: the key is tenant, time to the second, and event id.

    Of rows that differ below the second or in the rest, the one with the greatest occurred_at, then the greatest rest, is kept.
    """
    second = df.withColumn("__second", F.date_trunc("second", "occurred_at"))
    return latest(second, ["tenant_id", "__second", "event_id"], ["occurred_at"]).drop("__second")


def final_rollup(df: DataFrame) -> DataFrame:
    """The valid rollup rows: the greatest inserted_at of each tenant, type and date."""
    return latest(df, ["tenant_id", "event_type", "date"], ["inserted_at"])


def anti_insert(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't there yet, one per key: insert, ignoring what exists."""
    return new.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def upsert_add(old: DataFrame, delta: DataFrame, key: list[str], amounts: list[str]) -> DataFrame:
    """Add amounts to keys, making new keys: union and re-aggregate."""
    both = old.select(*key, *amounts).unionByName(delta.select(*key, *amounts))
    kinds = dict(both.dtypes)
    return both.groupBy(*key).agg(*[(exact_sum(F.col(a)) if kinds[a] == "double" else F.sum(a)).alias(a) for a in amounts])


def with_any(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``; each once, however often it occurs."""
    return df.join(other.select(*key), key, "left_semi")


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()
