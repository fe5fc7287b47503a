"""Service-level queries over request metrics (ts, method, path, status, duration in seconds)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions.ordered import usable, with_code
from driftline.operators import ranks

# Histogram bounds in seconds, and the error budget.
HTTP_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.5, 10.0]
OLAP_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
BUDGET = 0.005
SELF = "/api/v1/metrics"


def requests(metrics: DataFrame) -> DataFrame:
    """Without the scraping of the metrics themselves."""
    return metrics.where(F.col("path") != SELF)


def histogram(metrics: DataFrame, by: list[str], bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts: (by, le, n) for each bound and +Inf, in one aggregation."""
    bounds = bounds or HTTP_BUCKETS
    counts = metrics.groupBy(*by).agg(*[F.count_if(F.col("duration") <= b).alias(f"c{i}") for i, b in enumerate(bounds)], F.count("*").alias("inf"))
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"c{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n")))
    return counts.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.le", "r.n")


def quantile(hist: DataFrame, by: list[str], q: float) -> DataFrame:
    """Linear interpolation inside the bucket that holds the rank; in the last, its lower bound."""
    w = Window.partitionBy(*by).orderBy("le")
    h = (hist.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
         .withColumn("rank", F.max("n").over(Window.partitionBy(*by)) * F.lit(q)))
    hit = h.where("rank <= n AND (rank > below OR below = 0 AND n > 0)").withColumn("k", F.row_number().over(w)).where("k = 1")
    inside = F.col("lo") + (F.col("le") - F.col("lo")) * ((F.col("rank") - F.col("below")) / (F.col("n") - F.col("below")))
    return hit.select(*by, F.when(F.isnan("le") | (F.col("le") == float("inf")), F.col("lo")).otherwise(inside).alias("value"))


def is_error() -> Column:
    return F.col("status").like("5%")


def error_ratio(metrics: DataFrame, width: str = "1 hour") -> DataFrame:
    """(bucket_ts, requests, errors, error_ratio) per bucket; no errors is 0."""
    got = requests(metrics).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("requests"), F.count_if(is_error()).alias("errors"))
    return got.select(F.col("w.start").alias("bucket_ts"), "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_ratio"))


def rolling_error_ratio(minutes: DataFrame, seconds: int, out: str) -> DataFrame:
    """Ratio over the last ``seconds`` at each evaluation of per-minute counts (bucket_ts, requests, errors).

    Minutes are few, whatever the traffic: they were aggregated before. Evaluations are partitioned by day with
    the days before them added, so that no window spans the whole table in one task.
    """
    span = -(-seconds // 86400)
    days = minutes.withColumn("day", F.explode(F.sequence(F.to_date("bucket_ts"), F.date_add(F.to_date("bucket_ts"), span))))
    # What came up to now, less what came up to the window's start: frames that only grow, so each row is added once.
    w = Window.partitionBy("day").orderBy(F.unix_seconds("bucket_ts"))
    now, then = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, -seconds)
    within = lambda c: F.sum(c).over(now) - F.coalesce(F.sum(c).over(then), F.lit(0))
    got = days.withColumn("e", within("errors")).withColumn("n", within("requests")).where("day = to_date(bucket_ts)")
    return got.select("bucket_ts", F.coalesce(F.col("e") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias(out))


def budget_remaining(metrics: DataFrame) -> DataFrame:
    """1 - ratio / budget over everything given."""
    return requests(metrics).agg(F.count_if(is_error()).alias("e"), F.count("*").alias("n")).select(
        (F.lit(1.0) - F.coalesce(F.col("e") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)) / F.lit(BUDGET)).alias("remaining"))


def firing(evaluations: DataFrame, condition: Column, held: int, alert: str, by: list[str] | None = None, step: int = 3600) -> DataFrame:
    """An alert fires at an evaluation if its condition held at each of the last ``held`` ones, ``step`` seconds apart; one that is missing didn't hold.

    Days are windows of their own, into which the evaluations before midnight are carried, so that no window spans the whole table.
    """
    by, reach = by or [], (held - 1) * step
    days = F.sequence(F.to_date("bucket_ts"), F.to_date(F.col("bucket_ts") + F.make_dt_interval(secs=F.lit(reach))))
    w = Window.partitionBy(*by, "__day").orderBy(F.unix_seconds("bucket_ts")).rangeBetween(-reach, 0)
    got = evaluations.withColumn("__ok", F.coalesce(condition, F.lit(False)).cast("int")).withColumn("__day", F.explode(days))
    got = got.withColumn("firing", F.sum("__ok").over(w) == held).where("__day = to_date(bucket_ts)")
    return got.select(F.lit(alert).alias("alert"), "bucket_ts", "firing", *by)


def minutes(metrics: DataFrame) -> DataFrame:
    """(bucket_ts, requests, errors) of every minute from the first to the last, also of those without requests."""
    counts = scratch.table(requests(metrics).groupBy(F.date_trunc("minute", "ts").alias("bucket_ts")).agg(
        F.count("*").alias("requests"), F.count_if(is_error()).alias("errors")), "slo-minutes")
    ends = counts.agg(F.min("bucket_ts").alias("a"), F.max("bucket_ts").alias("z"))
    days = ends.where("a IS NOT NULL").select("a", "z", F.explode(F.sequence(F.to_date("a"), F.to_date("z"))).alias("d"))
    start, end = F.greatest("a", F.col("d").cast("timestamp")), F.least("z", F.col("d").cast("timestamp") + F.expr("INTERVAL '23:59' HOUR TO MINUTE"))
    grid = days.select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MINUTE"))).alias("bucket_ts"))
    return grid.join(counts, "bucket_ts", "left").select("bucket_ts", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("errors", F.lit(0)).alias("errors"))


def rolling_quantiles(metrics: DataFrame, by: list[str], quantiles: dict[str, float], seconds: int = 300, bounds: list[float] | None = None) -> DataFrame:
    """(bucket_ts, by, one column per quantile) at each minute over the ``seconds`` that end with it; a minute with no requests in them has no row."""
    per_minute = histogram(requests(metrics).withColumn("__m", F.date_trunc("minute", "ts")), ["__m", *by], bounds)
    ahead = F.explode(F.sequence(F.lit(0), F.lit(seconds // 60 - 1)))
    at = per_minute.withColumn("k", ahead).withColumn("bucket_ts", F.col("__m") + F.make_dt_interval(mins=F.col("k")))
    key = ["bucket_ts", *by]
    hist = scratch.table(at.groupBy(*key, "le").agg(F.sum("n").alias("n")), "slo-histograms")
    out = None
    for name, q in quantiles.items():
        one = quantile(hist, key, q).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, key)
    return out


def alerts(metrics: DataFrame) -> DataFrame:
    """(alert, bucket_ts, method, path, firing): the six alerts at each minute; method and path are null where an alert has none."""
    slow = scratch.table(rolling_quantiles(metrics, ["method", "path"], {"p95": 0.95, "p99": 0.99}), "slo-quantiles")
    m = scratch.table(minutes(metrics), "slo-evaluations")
    by, ratio = ["method", "path"], lambda seconds: rolling_error_ratio(m, seconds, "ratio")
    out = [firing(slow.where(F.col("path").startswith("/api/v1/tenants")), F.col("p99") > 0.2, 6, "tenant_p99", by, 60),
           firing(slow.where((F.col("path") == "/api/v1/events") & (F.col("method") == "POST")), F.col("p99") > 0.5, 6, "ingest_p99", by, 60),
           firing(slow.where(F.col("path").startswith("/api/v1/events") & (F.col("method") == "GET")), F.col("p95") > 0.3, 6, "read_p95", by, 60),
           firing(ratio(300), F.col("ratio") > 0.02, 3, "fast_burn", None, 60), firing(ratio(3600), F.col("ratio") > 0.005, 16, "slow_burn", None, 60),
           firing(ratio(7 * 86400), F.lit(1.0) - F.col("ratio") / F.lit(BUDGET) < 0, 6, "budget_exhausted", None, 60)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out).select("alert", "bucket_ts", "method", "path", "firing")


def exposition(metrics: DataFrame) -> DataFrame:
    """(line): the samples as a scraper reads them, counters by status and cumulative buckets."""
    def labels(**of) -> Column:
        parts = [F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in of.items()]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("} "))

    counts = metrics.groupBy("method", "path", "status").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("requests_total"), labels(method=F.col("method"), path=F.col("path"), status=F.col("status")), F.col("n").cast("string")).alias("line"))
    shown = F.create_map(*[F.lit(x) for b in HTTP_BUCKETS for x in (b, f"{b:g}")])
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(shown[F.col("le")])
    buckets = histogram(metrics, ["method", "path"]).select(
        F.concat(F.lit("request_duration_seconds_bucket"), labels(method=F.col("method"), path=F.col("path"), le=le), F.col("n").cast("string")).alias("line"))
    return counts.unionByName(buckets)


def rate(metrics: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Requests a second by method and path."""
    seconds = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    got = requests(metrics).groupBy(F.window("ts", width).alias("w"), "method", "path").agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("bucket_ts"), "method", "path", (F.col("n") / seconds).alias("per_second"))


def by_status(metrics: DataFrame, width: str = "5 minutes") -> DataFrame:
    return requests(metrics).groupBy(F.window("ts", width).start.alias("bucket_ts"), "status").agg(F.count("*").alias("increase"))


def nearest_ranks(samples: DataFrame, by: str, value: str, permille: list[int]) -> DataFrame:
    """(by, permille, value): nearest-rank percentiles of each group, exact, from histograms over all groups at once."""
    v = F.col(value).cast("double")
    counted = samples.where(usable(v)).select(by, F.when(v == 0.0, F.lit(0.0)).otherwise(v).alias("value")).groupBy(by, "value").agg(F.count("*").alias("n"))
    return ranks.nearest(scratch.table(with_code(counted, "value", "code"), "slo-counts"), [by], permille)


def thresholds(metrics: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """(path, q, value, ok): the nearest-rank percentile of each path against its limit (permille, seconds)."""
    got = nearest_ranks(metrics.where(F.col("path").isin(list(limits))), "path", "duration", sorted({int(p) for p, _ in limits.values()}))
    asked = metrics.sparkSession.createDataFrame([(path, int(p), float(most)) for path, (p, most) in limits.items()], "path string, permille int, most double")
    return got.join(F.broadcast(asked), ["path", "permille"]).select(  # as many rows as limits were given
        "path", (F.col("permille") / 1000).alias("q"), "value", (F.col("value") < F.col("most")).alias("ok"))


def summary(timings: DataFrame) -> DataFrame:
    """(metric, min, median, max); the median of an even number is the upper one.

    The upper median is the negated lower median of the negated values, which exact selection finds without
    gathering a metric's values.
    """
    low = nearest_ranks(timings.select("metric", (-F.col("value")).alias("value")), "metric", "value", [500])
    ends = timings.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return ends.join(low.select("metric", (-F.col("value")).alias("median")), "metric").select("metric", "min", "median", "max")
