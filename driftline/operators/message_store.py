"""Exactly one copy of each message that was delivered at least once.

Messages live in hash-bucketed sorted storage: a message's bucket is the hash of its identifier
(tenant and canonical event id), and each upsert adds one sorted run per bucket. Upserts are
idempotent: a run belongs to its batch, a batch written again replaces its own run, and one that was merged
already is left out. Compaction merges the sorted runs of a bucket, so that equal identifiers collapse to one;
the buckets of all runs line up, so nothing is shuffled.

A manifest says which runs there are, which batches each holds, and how many buckets. It is written under the next
number and never changed, so the store can be opened again, and a crash leaves the manifest of before with all its
runs; what it doesn't name is not read, and is removed by the next commit. There is one writer at a time.

The number of buckets follows the size of the first batch (``BUCKET_BYTES`` each). A run goes through one exchange: that of
the aggregate which collapses copies, made by the bucket's own hash into as many parts as there are buckets.

The copy that is kept is the first received (least received_at, then least delivery_id); ``copies``
counts the deliveries. Within a run copies collapse before that exchange, so an identifier delivered in
a third of all rows is no hot key.

Defined results: identifiers that are the same UUID in another notation (upper case, braces, urn:uuid:,
without hyphens, blanks around) are equal; other texts are compared trimmed and in lower case; an event id
under two tenants is two messages; a null tenant or event id identifies nothing, so such a row is a
message of its own; an empty table gives no rows; extra columns are not stored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import scratch

#: Bytes of input a bucket takes, and the least and most buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 * 1024 * 1024, 8, 65_536
#: Spark gives a size like this to what it can't tell the size of; then a row counts as so many bytes.
UNKNOWN_BYTES, ROW_BYTES = 1 << 50, 100
#: What tells messages apart: a UUID as 16 bytes, another text as it is, or the delivery if nothing identifies it.
KEY = ["tenant_id", "event_id", "other_id", "lone"]
STORED = "tenant_id string, event_id binary, other_id string, lone bigint, first_at timestamp, delivery_id bigint, occurred_at timestamp, batch_id bigint, copies bigint"
MESSAGES = "tenant_id string, event_id string, delivery_id bigint, occurred_at timestamp, batch_id bigint, first_at timestamp, copies bigint"


def canonical_uuid(raw: Column) -> Column:
    """Lower-case hyphenated form of a UUID in any notation; other texts trimmed, in lower case."""
    text = F.lower(F.trim(raw))
    digits = F.regexp_replace(text, r"^urn:uuid:|[{}-]", "")
    hyphened = F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.substring(digits, 13, 4),
                           F.substring(digits, 17, 4), F.substring(digits, 21, 12))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), hyphened).otherwise(text)


class MessageStore:
    """One table below ``path``, partitioned by run, bucketed and sorted by ``KEY``; opened again as it was left."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or scratch.new_path(spark, "messages")).rstrip("/")
        self.table = f"driftline_{uuid.uuid4().hex}"
        self.number, known, self.runs = self._manifest()
        self.buckets = known or buckets

    # A manifest: {"buckets": n, "runs": {run: [batches]}}. The greatest number holds.
    def _manifest(self) -> tuple[int, int | None, dict[str, list[str]]]:
        numbers = [int(n) for n in scratch.names(self.spark, f"{self.path}/manifests") if n.isdigit()]
        if not numbers:
            return 0, None, {}
        got = json.loads(scratch.read_text(self.spark, f"{self.path}/manifests/{max(numbers)}"))
        return max(numbers), got["buckets"], got["runs"]

    def _commit(self, runs: dict[str, list[str]]) -> None:
        scratch.write_text(self.spark, f"{self.path}/manifests/{self.number + 1}", json.dumps({"buckets": self.buckets, "runs": runs}))
        self.number, self.runs = self.number + 1, runs
        for name in scratch.names(self.spark, f"{self.path}/runs"):
            run = name.partition("=")[2]
            if run and run not in runs:
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (run = '{run}')")
                scratch.remove(self.spark, f"{self.path}/runs/{name}")

    def _open(self) -> str:
        """The table, entered in the catalog if this store hasn't yet, with the manifest's runs."""
        if not self.spark.catalog.tableExists(self.table):
            self.spark.sql(f"CREATE TABLE {self.table} ({STORED}, run string) USING parquet PARTITIONED BY (run) CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'")
            for run in self.runs:
                self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS PARTITION (run = '{run}')")
        return self.table

    def close(self) -> None:
        """Take the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def upsert(self, deliveries: DataFrame, batch: str) -> None:
        """Add the deliveries of one batch as a sorted run; a batch written again replaces itself, a merged one stays."""
        if any(batch in batches and len(batches) > 1 for batches in self.runs.values()):
            return
        if self.buckets is None:
            self.buckets = _buckets(deliveries)
        rows = (
            deliveries.select("tenant_id", canonical_uuid(F.col("event_id")).alias("id_text"), "delivery_id", "occurred_at",
                              "batch_id", "received_at")
            .withColumn("lone", F.when(F.col("tenant_id").isNull() | F.col("id_text").isNull(), F.col("delivery_id")))
            .withColumn("uuid", F.col("id_text").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))
            .withColumn("event_id", F.when(F.col("uuid"), F.unhex(F.regexp_replace("id_text", "-", ""))))
            .withColumn("other_id", F.when(~F.col("uuid"), F.col("id_text")))
            .withColumn("first", F.struct(F.col("received_at").alias("first_at"), "delivery_id", "occurred_at", "batch_id"))
            .withColumn("copies", F.lit(1).cast("long"))
        )
        run = self._write(rows)
        self._commit({**{r: b for r, b in self.runs.items() if b != [batch]}, run: [batch]})

    def _write(self, rows: DataFrame) -> str:
        """A new run of these rows, copies collapsed."""
        run, table = f"r{uuid.uuid4().hex}", self._open()
        with _exchange_by_bucket(self.spark, self.buckets):
            _merged(rows).withColumn("run", F.lit(run)).write.insertInto(table)
        return run

    def _stored(self) -> DataFrame:
        return self.spark.table(self._open()).where(F.col("run").isin(sorted(self.runs)))

    def messages(self) -> DataFrame:
        """One row per message: tenant_id, event_id, delivery_id, occurred_at, batch_id, first_at, copies."""
        if not self.runs:
            return self.spark.createDataFrame([], MESSAGES)
        if len(self.runs) == 1:  # merged already; by its path, so that it can be read after the store is closed
            path = f"{self.path}/runs/run={next(iter(self.runs))}"
            got = self.spark.read.schema(STORED).parquet(path) if scratch.exists(self.spark, path) else self.spark.createDataFrame([], STORED)
        else:
            got = _merged(_with_first(self._stored()))
        digits = F.lower(F.hex("event_id"))
        text = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        return got.select("tenant_id", F.when(F.col("event_id").isNotNull(), text).otherwise(F.col("other_id")).alias("event_id"),
                          "delivery_id", "occurred_at", "batch_id", "first_at", "copies")

    def compact(self) -> None:
        """Merge all runs to one sorted run; batches merged in are no longer replaceable one by one."""
        if len(self.runs) > 1:
            run = self._write(_with_first(self._stored()))
            self._commit({run: sorted(b for batches in self.runs.values() for b in batches)})


def _with_first(rows: DataFrame) -> DataFrame:
    return rows.withColumn("first", F.struct("first_at", "delivery_id", "occurred_at", "batch_id"))


def _merged(rows: DataFrame) -> DataFrame:
    """Equal identifiers to one row: the first received, and the number of copies. Combined before any shuffle."""
    got = rows.groupBy(*KEY).agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    return got.select(*KEY, "first.first_at", "first.delivery_id", "first.occurred_at", "first.batch_id", "copies")


def _buckets(deliveries: DataFrame) -> int:
    """As many buckets as the input's size asks for: that of its files, or if it is in none, its rows."""
    size = int(str(deliveries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        size = deliveries.count() * ROW_BYTES
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))


@contextmanager
def _exchange_by_bucket(spark: SparkSession, buckets: int) -> Iterator[None]:
    """Aggregates run in it exchange by their keys into ``buckets`` parts, which are just the buckets of a table bucketed by them."""
    wanted = {"spark.sql.shuffle.partitions": str(buckets), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
