"""Totals and averages over trailing periods for each entity and day, days without activity included.

The state of a day holds an entity's totals over its trailing spans, and a version. A day's state is
yesterday's totals plus today's arrivals less the amounts of the day that expires. ``build`` does
that for all days: each day's amounts are joined with those expiring on it, and a window carries
the totals on from day to day. ``advance`` does it for one new day, ``correct`` for changed days within the state.

:class:`TrailingStore` keeps the state. A batch of rollup rows, new days and corrections alike, changes some daily amounts; each
change reaches the dates of the longest span from it on, and a first or last active day that moves reaches those that come to lie
inside or outside. Only these dates are recomputed, run of days by run of days: from the stored totals of the day before the run,
plus arrivals, less expiring amounts. They are appended under the batch's version; of each date the greatest version holds.

Amounts are decimals, so what is added and taken away again leaves exactly zero. An entity's days are
bounded by the calendar, however many rows it has: those are summed per day before anything else.

Defined results: the valid row of an (entity, type, day) has the greatest inserted_at (ties: the
greater count, then total); a null inserted_at is older than any; null and NaN amounts, and those of 1e20 or more in size (infinities too), add 0; null types are a
type; rows with a null entity or day are left out; days run from the first to the last active day (event_count above 0); an entity
never active has no rows; averages are per day of the span, whether or not the span reaches back
before the first day; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline import scratch

SPANS = (7, 30)
MONEY = "decimal(28,4)"


def daily(stats: DataFrame, entity: str = "tenant_id", day: str = "date") -> DataFrame:
    """(entity, day, n, v): valid rows summed per day."""
    valid = (
        stats.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), "event_type", F.col(day).alias("day"))
        .agg(F.max(F.struct("inserted_at", "event_count", "total_value")).alias("r"))
    )
    v = F.col("r.total_value")
    return valid.groupBy("entity", "day").agg(
        F.sum(F.coalesce("r.event_count", F.lit(0))).alias("n"),
        F.coalesce(F.sum(F.when(~F.isnan(v) & (F.abs(v) < 1e20), v).cast(MONEY)), F.lit(0)).cast("decimal(38,4)").alias("v"))


def build(amounts: DataFrame, spans: tuple[int, ...] = SPANS, version: int = 1) -> DataFrame:
    """State of every day from each entity's first to its last active day: entity, day, n, v,
    n_<span>, v_<span> for each span, version."""
    active = amounts.where("n > 0").groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    days = active.select("entity", F.explode(F.sequence("first", "last")).alias("day"))
    state = days.join(amounts, ["entity", "day"], "left").select(
        "entity", "day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).cast("decimal(38,4)").alias("v"))
    carry = Window.partitionBy("entity").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    for s in spans:
        expiring = amounts_of(state).select("entity", F.date_add("day", s).alias("day"), F.col("n").alias("n_out"), F.col("v").alias("v_out"))
        state = (
            state.join(expiring, ["entity", "day"], "left")
            .withColumn(f"n_{s}", F.sum(F.col("n") - F.coalesce("n_out", F.lit(0))).over(carry))
            .withColumn(f"v_{s}", F.sum(F.col("v") - F.coalesce("v_out", F.lit(0))).over(carry).cast("decimal(38,4)"))
            .drop("n_out", "v_out")
        )
    return state.withColumn("version", F.lit(version))


def amounts_of(state: DataFrame) -> DataFrame:
    return state.select("entity", "day", "n", "v")


def advance(state: DataFrame, arrivals: DataFrame, day: str, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """The state of ``day`` from yesterday's, today's arrivals (entity, n, v) and the expiring days."""
    today = F.lit(day).cast("date")
    yesterday = state.where(F.col("day") == F.date_sub(today, 1))
    out = yesterday.drop("n", "v", "day").join(arrivals.select("entity", "n", "v"), "entity", "full")
    for s in spans:
        gone = amounts_of(state).where(F.col("day") == F.date_sub(today, s)).select("entity", F.col("n").alias("n_out"), F.col("v").alias("v_out"))
        out = out.join(gone, "entity", "left")
        for c in ("n", "v"):
            total = F.coalesce(f"{c}_{s}", F.lit(0)) + F.coalesce(c, F.lit(0)) - F.coalesce(f"{c}_out", F.lit(0))
            out = out.withColumn(f"{c}_{s}", total.cast("decimal(38,4)" if c == "v" else "long"))
        out = out.drop("n_out", "v_out")
    return out.select("entity", today.alias("day"), F.coalesce("n", F.lit(0)).alias("n"),
                      F.coalesce("v", F.lit(0)).cast("decimal(38,4)").alias("v"),
                      *[f"{c}_{s}" for s in spans for c in ("n", "v")], F.coalesce("version", F.lit(1)).alias("version"))


def correct(state: DataFrame, changed: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Apply new daily amounts (entity, day, n, v) of days in the state's range; others take a :class:`TrailingStore`.

    Only dates from a changed day to span - 1 days after it are recomputed and get the next version.
    """
    now, old = changed.alias("c"), amounts_of(state).alias("o")
    delta = now.join(old, ["entity", "day"]).select(
        "entity", "day", (F.col("c.n") - F.col("o.n")).alias("dn"), (F.col("c.v") - F.col("o.v")).alias("dv")).where("dn <> 0 OR dv <> 0")
    reach = delta.select("entity", F.col("day").alias("from"), "dn", "dv", F.explode(F.sequence(F.lit(0), F.lit(max(spans) - 1))).alias("k"))
    reach = reach.select("entity", F.date_add("from", F.col("k")).alias("day"), "k", "dn", "dv").groupBy("entity", "day").agg(
        *[F.coalesce(F.sum(F.when(F.col("k") < s, F.col(f"d{c}"))), F.lit(0)).alias(f"d{c}_{s}") for s in spans for c in ("n", "v")],
        *[F.coalesce(F.sum(F.when(F.col("k") == 0, F.col(f"d{c}"))), F.lit(0)).alias(f"d{c}") for c in ("n", "v")],
        F.lit(True).alias("hit"))
    out = state.join(reach, ["entity", "day"], "left")
    for c in ["n", "v", *[f"{c}_{s}" for s in spans for c in ("n", "v")]]:
        kind = "decimal(38,4)" if c[0] == "v" else "long"
        out = out.withColumn(c, (F.col(c) + F.coalesce(f"d{c}", F.lit(0))).cast(kind))
    return out.withColumn("version", F.col("version") + F.when(F.col("hit"), 1).otherwise(0)).select(*state.columns)


def long_form(state: DataFrame, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """(entity, day, span, event_count, total_value, avg_count, avg_value), one row per span."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.col(f"n_{s}").alias("event_count"), F.col(f"v_{s}").alias("v")) for s in spans]))
    return state.select("entity", "day", rows.alias("r")).select(
        "entity", "day", "r.span", "r.event_count", F.col("r.v").cast("double").alias("total_value"),
        (F.col("r.event_count") / F.col("r.span")).alias("avg_count"),
        (F.col("r.v").cast("double") / F.col("r.span")).alias("avg_value"))


class TrailingStore:
    """Versioned rolling state below ``path``: valid rollup rows, daily amounts, active ranges and trailing totals, each appended
    under the batch's number. A batch that failed half way is written again under its own number."""

    STATS = "entity string, event_type string, day date, inserted_at timestamp, event_count long, total_value double, version int"
    AMOUNTS = f"entity string, day date, n long, v {'decimal(38,4)'}, version int"
    RANGES = "entity string, first date, last date, version int"

    def __init__(self, spark: SparkSession, path: str | None = None, spans: tuple[int, ...] = SPANS):
        self.spark, self.spans = spark, spans
        self.path = path or scratch.new_path(spark, "trailing")
        # The state is a version's last part, so it tells which versions are whole.
        done = [n.partition("=")[2] for n in scratch.names(spark, f"{self.path}/state") if scratch.exists(spark, f"{self.path}/state/{n}/_SUCCESS")]
        self.version = max(map(int, done), default=0)
        self.state_schema = "entity string, day date, n long, v decimal(38,4), " + ", ".join(f"n_{x} long, v_{x} decimal(38,4)" for x in spans) + ", alive boolean, version int"

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        got = self.spark.read.schema(schema).parquet(path) if scratch.exists(self.spark, path) else self.spark.createDataFrame([], schema)
        return got.where(F.col("version") <= self.version)

    def _latest(self, name: str, schema: str, key: list[str]) -> DataFrame:
        """The greatest version of each key; combined before the shuffle."""
        rows = self._read(name, schema)
        rest = [c for c in rows.columns if c not in key and c != "version"]
        got = rows.groupBy(*key).agg(F.max_by(F.struct(*rest, "version"), "version").alias("r"))
        return got.select(*key, *[F.col(f"r.{c}").alias(c) for c in [*rest, "version"]])

    def _append(self, rows: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.path}/{name}/version={version}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def state(self) -> DataFrame:
        """entity, day, n, v, n_<span>, v_<span> for each span, version (of the batch that last changed the row)."""
        return self._latest("state", self.state_schema, ["entity", "day"]).where("alive").drop("alive")

    def apply(self, stats: DataFrame, entity: str = "tenant_id", day: str = "date") -> None:
        """One batch of rollup rows: days that are new, and corrections of any day."""
        version, key, longest = self.version + 1, ["entity", "day"], max(self.spans)
        kind = ["entity", "event_type", "day"]
        figures = F.struct("inserted_at", "event_count", "total_value")
        fresh = stats.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(
            F.col(entity).alias("entity"), "event_type", F.col(day).alias("day"), figures.alias("f")).groupBy(*kind).agg(F.max("f").alias("f")).select(*kind, "f.*")
        fresh = self._append(fresh, "stats", version)
        # Amounts of the days the batch touches, from the valid rows of these days.
        touched = fresh.select(*key).distinct()
        ends = fresh.agg(F.min("day").alias("a"), F.max("day").alias("z")).first()
        known = self._read("stats", self.STATS).drop("version").where(F.col("day").between(F.lit(ends.a), F.lit(ends.z))).join(touched, key, "left_semi").unionByName(fresh)
        now = daily(known, "entity", "day").select(*key, "n", "v")
        amounts = self._latest("amounts", self.AMOUNTS, key).drop("version")
        was = amounts.select(*key, F.col("n").alias("n_was"), F.col("v").alias("v_was"))
        changed = now.join(was, key, "left").where(~(F.col("n").eqNullSafe(F.col("n_was")) & F.col("v").eqNullSafe(F.col("v_was"))))
        changed = self._append(changed.select(*key, "n", "v"), "amounts", version)
        amounts = scratch.table(amounts.join(changed.select(*key), key, "left_anti").unionByName(changed), "trailing-amounts")
        # Active ranges of the entities that changed.
        moved = changed.select("entity").distinct()
        old = self._latest("ranges", self.RANGES, ["entity"]).select("entity", F.col("first").alias("f0"), F.col("last").alias("l0"))
        new = amounts.join(moved, "entity", "left_semi").where("n > 0").groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))
        new = self._append(moved.join(new, "entity", "left"), "ranges", version)
        both = scratch.table(new.join(old, "entity", "left"), "trailing-ranges")
        reached = self._reached(changed, both, longest)
        rows = scratch.table(reached.join(both, "entity"), "trailing-reached")
        inside = (F.col("day") >= F.col("first")) & (F.col("day") <= F.col("last"))
        totals = self._totals(rows.where(inside).select(*key, "first"), amounts)
        gone = rows.where(F.col("day").between(F.col("f0"), F.col("l0")) & ~F.coalesce(inside, F.lit(False))).select(*key, F.lit(False).alias("alive"))
        self._append(totals.withColumn("alive", F.lit(True)).unionByName(gone, allowMissingColumns=True), "state", version)
        self.version = version
        for t in (amounts, both, rows):
            scratch.drop(t)

    def _reached(self, changed: DataFrame, ranges: DataFrame, longest: int) -> DataFrame:
        """(entity, day) of all dates that changes reach; the dates of an entity are bounded by the calendar."""
        def days(df: DataFrame, a, z) -> DataFrame:
            return df.select("entity", a.alias("a"), z.alias("z")).where("a <= z").select("entity", F.explode(F.sequence("a", "z")).alias("day"))

        f, f0, last, l0 = (F.col(c) for c in ("first", "f0", "last", "l0"))
        parts = [days(changed, F.col("day"), F.date_add("day", longest - 1)),
                 days(ranges.where(~f.eqNullSafe(f0) & f.isNotNull() & f0.isNotNull()), F.least(f, f0), F.date_add(F.greatest(f, f0), longest - 1)),
                 days(ranges.where(~last.eqNullSafe(l0) & last.isNotNull() & l0.isNotNull()), F.date_add(F.least(last, l0), 1), F.greatest(last, l0)),
                 days(ranges.where(f0.isNull() | f.isNull()), F.coalesce(f, f0), F.coalesce(last, l0))]
        return reduce(DataFrame.unionByName, parts).distinct()

    def _totals(self, dates: DataFrame, amounts: DataFrame) -> DataFrame:
        """Totals of runs of dates: those of the day before the run, plus arrivals, less what expires."""
        key, by_day = ["entity", "day"], Window.partitionBy("entity").orderBy("day")
        out = dates.withColumn("run", F.date_sub("day", F.row_number().over(by_day)))
        out = out.join(amounts, key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "v": F.coalesce("v", F.lit(0)).cast("decimal(38,4)")})
        before = self.state().select("entity", F.date_add("day", 1).alias("day"), *[F.col(f"{c}_{x}").alias(f"{c}_{x}_base") for x in self.spans for c in "nv"])
        out = out.join(before, key, "left")
        start = F.row_number().over(Window.partitionBy("entity", "run").orderBy("day")) == 1
        out = out.withColumn("start", start & (F.col("day") > F.col("first")))
        for x in self.spans:
            gone = amounts.select("entity", F.date_add("day", x).alias("day"), F.col("n").alias(f"n_{x}_out"), F.col("v").alias(f"v_{x}_out"))
            out = out.join(gone, key, "left")
        carry = Window.partitionBy("entity", "run").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        for x in self.spans:
            counted = F.date_sub("day", x) >= F.col("first")  # what lies before the first active day was never added
            for c in "nv":
                step = F.col(c) - F.coalesce(F.when(counted, F.col(f"{c}_{x}_out")), F.lit(0)) + F.coalesce(F.when(F.col("start"), F.col(f"{c}_{x}_base")), F.lit(0))
                out = out.withColumn(f"{c}_{x}", F.sum(step).over(carry).cast("decimal(38,4)" if c == "v" else "long"))
        return out.select(*key, "n", "v", *[f"{c}_{x}" for x in self.spans for c in "nv"])
