"""Listing, searching and looking up events and audit entries of one tenant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import contains_text, limit_or


def of_tenant(df: DataFrame, tenant: str) -> DataFrame:
    """Isolation: every tenant-scoped read passes here; the tenant comes from the key, not the request."""
    return df.where(F.col("tenant_id") == tenant)


def between(df: DataFrame, first, last, column: str = "occurred_at") -> DataFrame:
    """Half-open time range."""
    return df.where((F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(last)))


def where_all(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """Conjunction of the conditions that are given."""
    given = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def newest(df: DataFrame, at: str, tie: str, limit: int | None = None, default: int = 100, most: int = 1000) -> DataFrame:
    """The newest rows by any time column, ties by another; rows without a time come last."""
    return df.orderBy(F.desc_nulls_last(at), tie).limit(limit_or(limit, default, most))


def recent(events: DataFrame, tenant: str | None = None, limit: int | None = None, default: int = 100, most: int = 1000) -> DataFrame:
    """Newest first, ties by id; a limit out of range takes the default."""
    got = of_tenant(events, tenant) if tenant is not None else events
    return got.orderBy(F.desc("occurred_at"), "event_id").limit(limit_or(limit, default, most))


def search(events: DataFrame, query: str, tenant: str | None = None, limit: int | None = None) -> DataFrame:
    got = of_tenant(events, tenant) if tenant is not None else events
    got = got.where(contains_text("payload", query))
    return got if limit is None else recent(got, None, limit)


def get(df: DataFrame, **key) -> DataFrame:
    """Point lookup: at most one row."""
    return where_all(df, [F.col(k) == v for k, v in key.items()]).limit(1)
