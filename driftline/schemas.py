"""Catalog of table schemas; tables are declared, never inferred."""

from pyspark.sql import types as T
from pyspark.sql.types import StructType

_DDL = {
    "tenants": "id string, name string, plan string, created_at timestamp, updated_at timestamp",
    "events": "event_id string, tenant_id string, event_type string, payload string, value double, occurred_at timestamp, pii_erased boolean",
    "event_log": "stream_position long, stream_name string, event_type string, data string, metadata string, occurred_at timestamp",
    "tenant_event_counts": "tenant_id string, event_type string, event_count long, total_value double",
    "daily_event_counts": "tenant_id string, event_date date, event_type string, event_count long, total_value double",
    "projection_positions": "projection string, last_position long, updated_at timestamp",
    "tenant_window_stats": "tenant_id string, event_type string, window_duration string, window_start timestamp, event_count long, sum_value double, is_late boolean, flushed_at timestamp",
    "tenant_daily_stats": "tenant_id string, event_type string, date date, event_count long, total_value double, inserted_at timestamp",
    "billing_records": "id string, tenant_id string, idempotency_key string, amount_cents long, currency string, status string, description string, created_at timestamp, outbox_sent_at timestamp",
    "tenant_credits": "tenant_id string, balance_cents long, updated_at timestamp",
    "consent_records": "tenant_id string, purpose string, granted boolean, granted_at timestamp, revoked_at timestamp, version int",
    "audit_log": "id long, tenant_id string, actor string, action string, resource_type string, resource_id string, details string, occurred_at timestamp",
    "api_keys": "id string, tenant_id string, key_hash binary, prefix string, scope string, name string, created_at timestamp, last_used_at timestamp, revoked_at timestamp",
    "idempotency_keys": "idempotency_key string, request_fingerprint binary, state string, response_status int, response_body binary, response_content_type string, created_at timestamp",
    "topic": "key binary, value binary, headers map<string,string>",
    "dead_letters": "original_topic string, original_partition int, original_offset long, key binary, value binary, reason string, attempts int, last_error string, failed_at timestamp",
    "metrics": "ts timestamp, method string, path string, status string, duration double",
}

_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(),
          "boolean": T.BooleanType(), "date": T.DateType(), "binary": T.BinaryType(), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def struct(ddl: str) -> StructType:
    """StructType of a DDL text, without a session."""
    return StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


SCHEMAS: dict[str, StructType] = {k: struct(v) for k, v in _DDL.items()}
#: What a log row's data holds.
DATA_SCHEMA = struct("tenant_id string, event_type string, payload string, value double, id string")
#: Rows that break these are rejected on write.
CHECKS = {
    "billing_records": "amount_cents > 0 AND status IN ('pending', 'completed', 'failed')",
    "tenant_credits": "balance_cents >= 0",
    "tenants": "plan IN ('free', 'pro', 'enterprise')",
    "api_keys": "(scope = 'admin') = (tenant_id IS NULL)",
}
APPEND_ONLY = {"audit_log", "event_log"}
CASCADE = ("events", "tenant_event_counts", "daily_event_counts", "billing_records", "tenant_credits", "consent_records", "api_keys")


def empty(spark, name: str):
    return spark.createDataFrame([], SCHEMAS[name])


def write(df, name: str, path: str, mode: str = "append") -> None:
    """Append rows of a cataloged table. Append-only tables take no other mode, and checks hold for every row."""
    if name in APPEND_ONLY and mode != "append":
        raise ValueError(f"{name} is append-only")
    df = df.select(*SCHEMAS[name].names)
    if name in CHECKS:
        from pyspark.sql import functions as F
        ok = F.coalesce(F.expr(CHECKS[name]), F.lit(False))
        first = SCHEMAS[name].names[0]
        df = df.withColumn(first, F.when(ok, F.col(first)).otherwise(F.raise_error(F.lit(f"row breaks the check of {name}")).cast(SCHEMAS[name][first].dataType)))
    df.write.mode(mode).parquet(path)
