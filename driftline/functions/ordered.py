"""Order-preserving integer codes of doubles, and sums that don't depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Doubles below this size are summed as decimals: exact, so equal in any order and partitioning.
EXACT_BELOW = 1e20
SUM_TYPE = "decimal(28,4)"


def usable(value: Column) -> Column:
    """Null and NaN have no place in an order of numbers or in a sum."""
    return value.isNotNull() & ~F.isnan(value)


def exact_sum(value: Column, weight: Column | None = None) -> Column:
    """Aggregate: sum of doubles to four decimals, independent of order; 0 for no usable value.

    Values of 1e20 and more (and infinities) can't be held as decimals of that scale; they are
    added as doubles on top.
    """
    ok = usable(value)
    small = F.when(ok & (F.abs(value) < EXACT_BELOW), value).cast(SUM_TYPE)
    large = F.when(ok & (F.abs(value) >= EXACT_BELOW), value)
    if weight is not None:
        small, large = small * weight.cast("decimal(15,0)"), large * weight
    low, high = F.coalesce(F.sum(small).cast("double"), F.lit(0.0)), F.sum(large)
    return F.when(high.isNull(), low).otherwise(low + high)


def with_code(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: a long that orders as the double ``value`` does (-0.0 as 0.0); null for null."""
    clean = F.when(F.col(value).isNull() | (F.col(value) == 0.0), F.lit(0.0)).otherwise(F.col(value))
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), clean)
    df = df.withColumn(out, bits.cast("long"))
    return df.withColumn(out, F.when(F.col(value).isNull(), None).when(F.col(out) < 0, F.col(out).bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(F.col(out)))
