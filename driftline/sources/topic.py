"""Topics: keyed messages as an unbounded stream.

A topic is a folder of Parquet files with (key, value, headers); with the Kafka connector on the class path the same
functions use it. Messages of a key stay in order: rows are partitioned by key and sorted within.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.codec import decode_events, encode_events
from driftline.functions.scalar import from_nanos
from driftline.schemas import SCHEMAS

TYPE = "application/x-protobuf"


def messages(events: DataFrame, order: list[str]) -> DataFrame:
    """Events as messages: key = tenant, binary value, headers event_type and content_type."""
    value = encode_events(F.col("event_id").cast("string"), "tenant_id", "event_type", "payload", "value", F.unix_micros("occurred_at"))
    return events.repartition("tenant_id").sortWithinPartitions("tenant_id", *order).select(
        F.encode("tenant_id", "utf-8").alias("key"), value.alias("value"),
        F.create_map(F.lit("event_type"), F.coalesce("event_type", F.lit("")), F.lit("content_type"), F.lit(TYPE)).alias("headers"))


def json_messages(records: DataFrame) -> DataFrame:
    """Records as JSON messages keyed by tenant."""
    return records.repartition("tenant_id").select(F.encode("tenant_id", "utf-8").alias("key"), F.encode(F.to_json(F.struct("*")), "utf-8").alias("value"),
                                                   F.create_map(F.lit("content_type"), F.lit("application/json")).alias("headers"))


def publish(rows: DataFrame, topic: str, kafka: dict | None = None) -> None:
    if kafka:
        out = rows.withColumn("headers", F.transform(F.map_entries("headers"), lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "utf-8").alias("value"))))
        out.write.format("kafka").options(**kafka).option("topic", topic).option("includeHeaders", "true").save()
    else:
        rows.write.mode("append").parquet(topic)


def subscribe(spark: SparkSession, topic: str, files_per_trigger: int = 100, kafka: dict | None = None) -> DataFrame:
    if kafka:
        return spark.readStream.format("kafka").options(**kafka).option("subscribe", topic).option("includeHeaders", "true").load()
    return located(spark.readStream.schema(SCHEMAS["topic"]).option("maxFilesPerTrigger", files_per_trigger).parquet(topic))


def located(rows: DataFrame) -> DataFrame:
    """Messages of a folder with where they are in it: the file is the partition, the row in it the offset."""
    return rows.select("*", F.crc32(F.col("_metadata.file_name").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int").alias("partition"), F.col("_metadata.row_index").alias("offset"))


def decoded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, undecodable messages with their error)."""
    d = rows.withColumn("d", decode_events("value"))
    good = d.where("d.error IS NULL").select(F.col("d.id").alias("event_id"), "d.tenant_id", "d.event_type", "d.payload", "d.value", from_nanos(F.col("d.occurred_ns")).alias("occurred_at"))
    return good, d.where("d.error IS NOT NULL").select(*rows.columns, F.col("d.error").alias("last_error"))


def dead_letters(bad: DataFrame, topic: str, reason: str, attempts: int) -> DataFrame:
    """Original bytes with where they came from and why they are here."""
    where = [F.col(c) if c in bad.columns else F.lit(None) for c in ("partition", "offset")]
    return bad.select(F.lit(topic).alias("original_topic"), where[0].cast("int").alias("original_partition"), where[1].cast("long").alias("original_offset"), "key", "value",
                      F.lit(reason).alias("reason"), F.lit(attempts).alias("attempts"), "last_error", F.current_timestamp().alias("failed_at"))


def dead_messages(dead: DataFrame) -> DataFrame:
    """Dead letters as messages of a topic of their own: the original bytes, and all the rest as headers."""
    names = ["original_topic", "original_partition", "original_offset", "reason", "attempts", "last_error"]
    values = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names} | {"failed_at": F.date_format("failed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    return dead.select("key", "value", F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)]).alias("headers"))
