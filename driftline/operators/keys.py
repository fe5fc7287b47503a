"""API keys joined to their tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import key_hash, key_prefix
from driftline.operators.final import anti_insert
from driftline.operators.joins import lookup_join


def with_tenant(keys: DataFrame, tenants: DataFrame) -> DataFrame:
    """Active keys with their tenant's plan; a key without a tenant keeps null."""
    active = keys.where("revoked_at IS NULL")
    side = tenants.select(F.col("id").alias("tenant_id"), "plan")
    return lookup_join(active, side, ["tenant_id"], "left")


def lookup(keys: DataFrame, tenants: DataFrame, secret: str) -> DataFrame:
    return with_tenant(keys.where(F.col("key_hash") == key_hash(F.lit(secret))), tenants).limit(1)


def mint(new: DataFrame) -> DataFrame:
    """Keys to store for (id, tenant_id, scope, secret): the hash and the display prefix, never the secret."""
    return new.select("id", "tenant_id", key_hash("secret").alias("key_hash"), key_prefix("secret").alias("prefix"), "scope",
                      F.lit(None).cast("string").alias("name"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("last_used_at"),
                      F.lit(None).cast("timestamp").alias("revoked_at"))


def ensure(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert keys whose hash isn't there."""
    return existing.unionByName(anti_insert(new, existing, ["key_hash"]))


def revoke(keys: DataFrame, key_id: str, at) -> DataFrame:
    """Revoking again changes nothing."""
    return keys.withColumn("revoked_at", F.when((F.col("id") == key_id) & F.col("revoked_at").isNull(), F.lit(at)).otherwise(F.col("revoked_at")))


def touch(keys: DataFrame, key_id: str, at) -> DataFrame:
    """last_used_at moves at most every five minutes."""
    t = F.lit(at).cast("timestamp")
    due = F.col("last_used_at").isNull() | (F.col("last_used_at") < t - F.expr("INTERVAL 5 MINUTES"))
    return keys.withColumn("last_used_at", F.when((F.col("id") == key_id) & due, t).otherwise(F.col("last_used_at")))


def permitted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (key_id, tenant_id) that their key may touch: its own tenant's, or any for an admin key."""
    k = keys.where("revoked_at IS NULL").select(F.col("id").alias("key_id"), F.col("tenant_id").alias("__owner"), "scope")
    return rows.join(k, "key_id").where((F.col("scope") == "admin") | (F.col("__owner") == F.col("tenant_id"))).drop("__owner", "scope")
