"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playstat.sources.schemas import HOT_KEY_ROWS

SALT_BUCKETS = 64


def salted_join(big: DataFrame, small: DataFrame, keys, how: str = "inner",
                hot_rows: int = HOT_KEY_ROWS, salt: int = SALT_BUCKETS) -> DataFrame:
    """``big.join(small, keys, how)`` where ``small`` has at most one row per key.

    Keys with more than ``hot_rows`` rows in ``big`` are found with a
    map-side-combined count; there are at most rows(big) / hot_rows of them, so
    that list is broadcast. Rows of a hot key get a salt in [0, salt) from a
    hash of the row (deterministic under retries), and the matching ``small``
    row is replicated ``salt`` times, so a hot key is joined by ``salt`` tasks.
    Other keys join with salt 0. Without a limit (``hot_rows`` 0) every key is
    salted, and there is no list. ``how``: inner, left, left_semi, left_anti."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if hot_rows <= 0:
        b = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salt)))
        s = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
        return b.join(s, keys + ["__salt"], how).drop("__salt")
    hot = (big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
           .filter(F.col("__n") > hot_rows).select(*keys).withColumn("__hot", F.lit(True)))
    b = (big.join(F.broadcast(hot), keys, "left")
         .withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salt)))
                     .otherwise(F.lit(0)).cast("bigint")).drop("__hot"))
    s = (small.join(F.broadcast(hot), keys, "left")
         .withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salt - 1)))
                                         .otherwise(F.array(F.lit(0))).cast("array<bigint>")))
         .drop("__hot"))
    return b.join(s, keys + ["__salt"], how).drop("__salt")


def join_maybe_salted(big: DataFrame, small: DataFrame, keys, how: str = "inner",
                      hot: bool = False, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Plain join unless the caller's size check says a key can be hot."""
    if hot:
        return salted_join(big, small, keys, how, hot_rows)
    return big.join(small, keys, how)
