"""Joins whose strategy follows a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most so many rows, and so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 * 1024 * 1024
#: Beyond it, the side is copied under so many salts, and each hot key is spread over as many tasks.
SALTS = 16
#: Where the rows of each key are known, only keys with more than this are salted.
HOT_ROWS = 1_000_000


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", small_rows: int | None = None,
                salt_by: str | None = None, limit: int = BROADCAST_ROWS, rows_of: str | None = None) -> DataFrame:
    """Join ``big`` to ``small`` (unique on ``keys``) without a hot key in one task.

    ``small`` is counted (or its count given). Up to ``limit`` rows it is broadcast. Beyond, it is
    replicated under ``SALTS`` salts and ``big`` is salted by a hash of ``salt_by`` (or of a row id),
    so that a key holding a third of all rows is shared by ``SALTS`` tasks. Keys compare null-safe.
    Such a side is joined by merging whatever Spark's own threshold says: Spark goes by the bytes of
    the files, which compress, and doesn't count the copies, so it would broadcast what was counted too large.
    ``how`` is inner or left. ``rows_of`` names a column of ``small`` that says how many rows of ``big`` its key has; then only keys with more than
    ``HOT_ROWS`` are joined apart (inner joins).
    """
    n, size = _measured(small) if small_rows is None else (small_rows, 0)
    if size > BROADCAST_BYTES:
        limit = -1
    if n > limit and rows_of and how == "inner":
        cold, hot = small.where(f"{rows_of} <= {HOT_ROWS}"), small.where(f"{rows_of} > {HOT_ROWS}")
        if not (n_hot := hot.count()):
            return _shuffled(big, small, keys, how)
        # Hot keys are at most as many as millions of rows: broadcast if counted few, else salted.
        apart = lookup_join(big, hot, keys, how, n_hot, salt_by, limit)
        is_hot = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys])
        rest = big.join(F.broadcast(is_hot) if n_hot <= limit else is_hot.hint("merge"), _all([big[k].eqNullSafe(is_hot[f"__h_{k}"]) for k in keys]), "left_anti")
        return _shuffled(rest, cold, keys, how).unionByName(apart)
    renamed = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    if n <= limit:
        cond = [big[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]
        joined = big.join(F.broadcast(renamed), _all(cond), how)
    else:
        salt = F.pmod(F.xxhash64(salt_by), F.lit(SALTS)) if salt_by else F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
        left = big.withColumn("__salt", salt)
        right = renamed.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(
            "__salt_r", F.col("__salt_r").cast("long"))
        cond = [left[k].eqNullSafe(right[f"__k_{k}"]) for k in keys] + [left["__salt"] == right["__salt_r"]]
        joined = left.join(right.hint("merge"), _all(cond), how).drop("__salt", "__salt_r")
    return joined.drop(*[f"__k_{k}" for k in keys])


def _measured(small: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of the values."""
    size = sum((F.coalesce(F.length(c).cast("long"), F.lit(0)) if t in ("string", "binary") else F.lit(8)) for c, t in small.dtypes)
    got = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return got.n, got["size"]


def _shuffled(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = small.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    return big.join(renamed.hint("merge"), _all([big[k].eqNullSafe(renamed[f"__k_{k}"]) for k in keys]), how).drop(*[f"__k_{k}" for k in keys])


def _all(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out
