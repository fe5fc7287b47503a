"""Read models that can be rebuilt from the log."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions.ordered import exact_sum
from driftline.operators.final import upsert_add
from driftline.schemas import DATA_SCHEMA


def ingested(log: DataFrame) -> DataFrame:
    """Ingested events of the log with their data parsed; malformed data fails the query."""
    d = F.from_json("data", DATA_SCHEMA, {"mode": "FAILFAST"})
    return log.where("event_type = 'EventIngested'").select(
        "stream_position", "occurred_at", d.alias("d")).select("stream_position", "occurred_at", "d.tenant_id", "d.event_type", "d.value")


class Projection(ABC):
    """An incremental aggregate of the log, kept with the position it has reached."""

    name: str
    key: list[str]
    amounts = ["event_count", "total_value"]

    @abstractmethod
    def transform(self, log: DataFrame) -> DataFrame:
        """The aggregate of some log rows."""

    def merge(self, old: DataFrame, delta: DataFrame) -> DataFrame:
        return upsert_add(old, delta, self.key, self.amounts)

    # State and position are committed together: the state is written under the position it stands
    # for, and the highest finished folder is the state.
    def _folder(self, root: str, position: int) -> str:
        return f"{root}/{self.name}/position={position:020d}"

    def position(self, spark: SparkSession, root: str) -> int:
        path = f"{root}/{self.name}"
        if not scratch.exists(spark, path):
            return 0
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(p)
                if scratch.exists(spark, f"{f.getPath()}/_SUCCESS")]
        return max(done, default=0)

    def state(self, spark: SparkSession, root: str) -> DataFrame | None:
        at = self.position(spark, root)
        return spark.read.parquet(self._folder(root, at)) if at else None

    def catch_up(self, log: DataFrame, root: str, head: int | None = None) -> int:
        """Apply all log rows after the position; idempotent, as the position moves with the state."""
        spark = log.sparkSession
        at = self.position(spark, root)
        head = log.agg(F.coalesce(F.max("stream_position"), F.lit(0))).first()[0] if head is None else head
        if head <= at:
            return at
        delta = self.transform(log.where((F.col("stream_position") > at) & (F.col("stream_position") <= head)))
        old = self.state(spark, root)
        (delta if old is None else self.merge(old, delta)).write.mode("overwrite").parquet(self._folder(root, head))
        return head

    def rebuild(self, log: DataFrame, root: str) -> int:
        scratch.remove(log.sparkSession, f"{root}/{self.name}")
        return self.catch_up(log, root)


class RunningTotals(Projection):
    name, key = "tenant_stats", ["tenant_id", "event_type"]

    def transform(self, log: DataFrame) -> DataFrame:
        return ingested(log).groupBy(*self.key).agg(F.count("*").alias("event_count"), exact_sum(F.col("value")).alias("total_value"))


class DailyCounts(Projection):
    name, key = "daily_event_counts", ["tenant_id", "event_date", "event_type"]

    def transform(self, log: DataFrame) -> DataFrame:
        return ingested(log).withColumn("event_date", F.to_date("occurred_at")).groupBy(*self.key).agg(
            F.count("*").alias("event_count"), exact_sum(F.col("value")).alias("total_value"))


def lag(positions: DataFrame, log: DataFrame) -> DataFrame:
    """(projection, last_position, head_position, lag): the head is read once."""
    head = log.agg(F.coalesce(F.max("stream_position"), F.lit(0))).scalar()
    return positions.withColumn("head_position", head).select(
        "projection", "last_position", "head_position", F.greatest(F.lit(0), F.col("head_position") - F.col("last_position")).alias("lag"))
