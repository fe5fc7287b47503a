"""Percentiles per group over large numeric columns, from partial results that can be combined.

The partial result of a day, file or partition is a table (groups, code, value, n): how many rows
hold each value, or each value rounded toward zero to ``mantissa_bits`` bits (relative error below
2**-mantissa_bits; 52, the default, keeps values exact). Partials of any split combine by adding n.

Exact bisection then keeps a value interval per group and percentile, counts rows below midpoints,
and narrows to the half that holds the rank. One pass takes ``STEPS`` halvings at once (the counts
below 2**STEPS - 1 midpoints), the bounds shrink to values that occur, and rows outside all
intervals leave.

Defined results: null and NaN values are left out; a group without values has no row; null is a group
of its own; percentiles are nearest ranks, so ties and single values need no interpolation; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline import scratch
from driftline.functions.ordered import usable, with_code
from driftline.operators import ranks

STEPS = 6
PERMILLE = [100, 500, 900, 990]


def partial(df: DataFrame, groups: list[str], value: str, mantissa_bits: int = 52) -> DataFrame:
    """Mergeable partial result of one part of the data."""
    v = F.col(value).cast("double")
    v = F.when(v == 0.0, F.lit(0.0)).otherwise(v)
    counted = df.where(usable(F.col(value).cast("double"))).select(*groups, v.alias("value"))
    if mantissa_bits < 52:
        counted = with_code(counted, "value", "code")
        low = (1 << (52 - mantissa_bits)) - 1
        toward_zero = F.when(F.col("code") >= 0, F.col("code").bitwiseAND(F.lit(~low).cast("long"))).otherwise(
            F.col("code").bitwiseOR(F.lit(low).cast("long")))
        # The least (largest, below zero) value of a rounded cell that occurs stands for it.
        return counted.groupBy(*groups, toward_zero.alias("code")).agg(
            F.when(F.min("value") >= 0, F.min("value")).otherwise(F.max("value")).alias("value"), F.count("*").alias("n"))
    return with_code(counted.groupBy(*groups, "value").agg(F.count("*").alias("n")), "value", "code").select(
        *groups, "code", "value", "n")


def combine(partials: DataFrame, groups: list[str]) -> DataFrame:
    """Add up partials of separate days or files, to these groups or to coarser ones."""
    return partials.groupBy(*groups, "code").agg(
        F.when(F.min("value") >= 0, F.min("value")).otherwise(F.max("value")).alias("value"), F.sum("n").alias("n"))


def percentiles(partials: DataFrame, groups: list[str], permille: list[int] | None = None, one_part: bool = False) -> DataFrame:
    """(groups, values, p10, p50, p90, p99) from partials of any number of parts.

    ``one_part``: ``partials`` is a single :func:`partial` by these very groups, so there is nothing to add up.
    """
    permille = permille or PERMILLE
    merged = scratch.table(partials if one_part else combine(partials, groups), "percentile-counts")
    sizes = merged.groupBy(*groups).agg(F.sum("n").alias("values"))

    def section(_: int):
        # Halved codes can't overflow when subtracted; an interval below 2**STEPS splits to single codes.
        span = "(shiftright(hi, 1) - shiftright(lo, 1))"
        return F.expr(f"CASE WHEN {span} < {1 << (STEPS - 1)} THEN code - lo "
                      f"ELSE (shiftright(code, 1) - shiftright(lo, 1)) div ({span} div {1 << STEPS} + 1) END")

    picked = ranks.resolve(merged, groups, permille, lambda: F.shiftright(F.col("code"), 52), section)
    p = ranks.wide(picked, groups, permille)
    p = p.select(*[F.col(g).alias(f"__{g}") for g in groups], *[ranks.column_of(x) for x in permille])
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return sizes.join(p, cond, "inner").drop(*[f"__{g}" for g in groups])
