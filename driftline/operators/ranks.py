"""Exact selection of ranks per group in passes over mergeable counts.

Shared by the histogram refinement for hot keys and by the bisection for percentiles. Rows are
(group columns, code, value, n): a value, its order code and how many rows hold it. In each pass
every group's open ranks choose one cell of codes; only rows in chosen cells go on. A cell that
holds a single value resolves its ranks. No group's values are ever gathered: what a pass keeps of a
group is its cells, whose number is fixed by the pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline import scratch
from driftline.operators.joins import lookup_join


def rank_of(n: Column, permille: Column) -> Column:
    """Nearest rank, 1-based: ceil(n * permille / 1000), in integers."""
    return F.greatest(F.expr("bigint(1)"), F.floor((n * permille + 999) / 1000).cast("long"))


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "cell").agg(
        F.sum("n").alias("n"), F.count("*").alias("m"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.min("value").alias("value"))


def resolve(weighted: DataFrame, groups: list[str], permille: list[int], first_cell: Callable[[], Column],
            next_cell: Callable[[int], Column]) -> DataFrame:
    """Rows (groups, permille, value) with the value of each rank; ``weighted`` must be cheap to read again.

    ``first_cell()`` gives the cell of the first pass from ``code``; ``next_cell(i)`` that of pass i
    from ``code`` and the chosen cell's bounds ``lo`` and ``hi``. Passes go on until no rank is open;
    a cell function must split any cell of two or more values after finitely many passes.
    """
    cells = _cells(weighted.withColumn("cell", first_cell()), groups)
    w = Window.partitionBy(*groups)
    at = (
        cells.withColumn("cum", F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("total", F.sum("n").over(w))
        .withColumn("permille", F.explode(F.array(*[F.lit(p) for p in permille])))
        .withColumn("rank", rank_of(F.col("total"), F.col("permille")))
        .where((F.col("rank") <= F.col("cum")) & (F.col("rank") > F.col("cum") - F.col("n")))
        .select(*groups, "permille", "cell", "lo", "hi", "value", "m", (F.col("rank") - F.col("cum") + F.col("n")).alias("rank"))
    )
    chosen = scratch.table(at, "ranks")
    done = [chosen.where("lo = hi").select(*groups, "permille", "value")]
    rows, step = weighted, 0
    kept: DataFrame | None = None
    while True:
        open_ = chosen.where("lo < hi")
        if open_.isEmpty():
            break
        step += 1
        by = [*groups, "cell"] if step == 1 else [*groups, "permille", "cell"]
        here = rows.withColumn("cell", first_cell()) if step == 1 else rows
        going = lookup_join(here.select(*by, "code", "value", "n"), open_.select(*groups, "permille", "cell", "lo", "hi", "rank", "m"),
                            by, salt_by="code", rows_of="m").drop("m")
        going = scratch.table(going.withColumn("cell", next_cell(step)), "ranks-rows")
        w = Window.partitionBy(*groups, "permille").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        at = (
            _cells(going.drop("lo", "hi"), [*groups, "permille", "rank"])
            .withColumn("cum", F.sum("n").over(w))
            .where((F.col("rank") <= F.col("cum")) & (F.col("rank") > F.col("cum") - F.col("n")))
            .withColumn("rank", F.col("rank") - F.col("cum") + F.col("n"))
            .select(*groups, "permille", "cell", "lo", "hi", "value", "m", "rank")
        )
        chosen = scratch.table(at, "ranks")
        scratch.drop(kept)
        rows = kept = going
        done.append(chosen.where("lo = hi").select(*groups, "permille", "value"))
    scratch.drop(kept)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


#: Bits of the order code that one pass of :func:`nearest` looks at.
DIGIT = 16


def first_digit() -> Column:
    return F.shiftright(F.col("code"), 64 - DIGIT)


def nearest(weighted: DataFrame, groups: list[str], permille: list[int]) -> DataFrame:
    """:func:`resolve` by histograms of 65,536 cells, refined digit by digit of the order code."""
    mask = F.lit((1 << DIGIT) - 1).cast("long")
    return resolve(weighted, groups, permille, first_digit, lambda i: F.shiftright(F.col("code"), 64 - DIGIT * (i + 1)).bitwiseAND(mask))


def wide(resolved: DataFrame, groups: list[str], permille: list[int]) -> DataFrame:
    """One row per group, one column p<permille/10> per rank."""
    return resolved.groupBy(*groups).agg(
        *[F.max(F.when(F.col("permille") == p, F.col("value"))).alias(column_of(p)) for p in permille])


def column_of(p: int) -> str:
    return f"p{p // 10}" if p % 10 == 0 else f"p{p // 10}_{p % 10}"
