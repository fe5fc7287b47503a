"""Masking by fixed patterns, and what a scan for them reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import CATEGORIES, contains_pii, mask_pii, pii_categories


def mask(df: DataFrame, text: str) -> DataFrame:
    """``text`` masked, and whether that changed it."""
    masked = mask_pii(text)
    return df.withColumn("changed", F.col(text).isNotNull() & (masked != F.col(text))).withColumn(text, masked)


def scan(df: DataFrame, text: str) -> DataFrame:
    """A flag for each category."""
    out = df
    for k, p in CATEGORIES.items():
        out = out.withColumn(f"has_{'ip' if k == 'ip_address' else k}", F.coalesce(F.col(text).rlike(p), F.lit(False)))
    return out


def category_counts(df: DataFrame, text: str) -> DataFrame:
    """(category, n), zero for a category that isn't found: one pass, one row per category."""
    counts = df.agg(*[F.count_if(F.col(text).rlike(p)).alias(k) for k, p in CATEGORIES.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in CATEGORIES])).alias("r")).select("r.*")


def scan_counts(events: DataFrame, text: str = "payload", tenant: str | None = None, since=None, limit: int | None = 10_000, tie: str = "event_id") -> DataFrame:
    """(scanned, with_pii, one count per category) over the newest events, in one pass; sorted and cut before anything is looked for."""
    from driftline.operators.search import newest, where_all
    got = where_all(events, [F.col("tenant_id") == tenant if tenant else None, F.col("occurred_at") >= F.lit(since) if since else None])
    if limit:
        got = newest(got, "occurred_at", tie, limit, limit, limit)
    return got.agg(F.count("*").alias("scanned"), F.count_if(contains_pii(text)).alias("with_pii"), *[F.count_if(F.col(text).rlike(p)).alias(k) for k, p in CATEGORIES.items()])


def report(events: DataFrame, text: str = "payload", tenant: str | None = None, since=None, limit: int | None = 10_000) -> str:
    """JSON report of a scan over the newest events: scanned, with_pii, by category, and the first findings."""
    from driftline.operators.search import where_all
    got = where_all(events, [F.col("tenant_id") == tenant if tenant else None, F.col("occurred_at") >= F.lit(since) if since else None])
    if limit:
        got = got.orderBy(F.desc("occurred_at"), "event_id").limit(limit)
    got = got.withColumn("categories", pii_categories(text))
    total = got.agg(F.count("*").alias("scanned"), F.count_if(F.size("categories") > 0).alias("with_pii")).first()
    first = got.where(contains_pii(text)).select("event_id", "tenant_id", "event_type", "categories").limit(20).collect()
    return json.dumps({"scanned": total["scanned"], "with_pii": total["with_pii"],
                       "categories": {r["category"]: r["n"] for r in category_counts(got, text).collect()},
                       "findings": [r.asDict() for r in first]}, default=str)
