"""Per-key results where a few keys hold most records.

Distributed exact selection: rows collapse to (key, value, count) before any shuffle by key, then
value histograms are refined digit by digit (16 bits of the value's order code at a time) until each
rank's cell holds one value. Counts are mergeable, so a hot key is spread over all tasks by value;
what a task ever holds of a key is its histogram of at most 65,536 cells.

Defined results: null and NaN values count as rows but not as values; a key without values has null
percentiles and total 0; null is a key of its own; ties take their common value; an empty table gives
no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions.ordered import exact_sum, usable, with_code
from driftline.operators import ranks

PERMILLE = [500, 900, 990]


def _values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): -0.0 and NaN are settled before grouping, one value, one group."""
    v = F.col(value).cast("double")
    return df.select(F.col(key).alias("key"), F.when(usable(v), F.when(v == 0.0, F.lit(0.0)).otherwise(v)).alias("value"))


def histograms(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, cell, n): each key's value histogram of at most 65,537 cells (null is one), counted before the shuffle.

    The first of the refinement's passes, straight from the scan. Histograms of parts add up.
    """
    return with_code(_values(df, key, value), "value", "code").groupBy("key", ranks.first_digit().alias("cell")).agg(F.count("*").alias("n"))


def profile(df: DataFrame, key: str, value: str, permille: list[int] | None = None) -> DataFrame:
    """(key, rows, values, total, p50, p90, p99): all keys, percentiles by nearest rank, exact."""
    permille = permille or PERMILLE
    counted = _values(df, key, value).groupBy("key", "value").agg(F.count("*").alias("n"))
    counted = scratch.table(with_code(counted, "value", "code"), "hot-counts")
    totals = counted.groupBy("key").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("values"),
        exact_sum(F.col("value"), F.col("n")).alias("total"))
    picked = ranks.nearest(counted.where("value is not null"), ["key"], permille)
    out = totals.join(ranks.wide(picked, ["key"], permille).withColumnRenamed("key", "__k"),
                      F.col("key").eqNullSafe(F.col("__k")), "left")
    return out.select(F.col("key").alias(key), "rows", "values", "total", *[ranks.column_of(p) for p in permille])


def hot(counts: DataFrame, share: float) -> DataFrame:
    """(key, n): keys of :func:`histograms` with at least ``share`` of all rows, by the totals of their histograms."""
    totals = scratch.table(counts.groupBy("key").agg(F.sum("n").alias("n")), "hot-totals")
    every = totals.agg(F.sum("n")).first()[0] or 0
    return totals.where(F.col("n") >= F.lit(share * every))
