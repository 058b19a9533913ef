"""Deterministic, partition-independent sampling (hash of seed and key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playstat.functions.tails import hash_uniform


def hash_sample(df: DataFrame, key, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli(fraction) per key value; the same key is always kept or dropped."""
    keys = [key] if isinstance(key, str) else list(key)
    if fraction >= 1.0:
        return df
    return df.filter(hash_uniform(seed, *keys) < fraction)


def sample_to_target(df: DataFrame, key, target: int, seed: int = 42) -> DataFrame:
    """min(target, rows) rows: those with the smallest hash uniforms, ties by key.

    A bounded top-k: every task keeps at most ``target`` rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("__u", hash_uniform(seed, *keys)).orderBy("__u", *keys).limit(target).drop("__u")


SHARES = 1 << 16            # equal shares of [0, 1) that uniforms are counted in


def sample_to_target_by_group(df: DataFrame, group, key, target: int, seed: int = 42) -> DataFrame:
    """min(target, rows) rows of every group: those with the smallest hash uniforms, ties by
    key. Exact, for any target.

    A count of the uniforms in ``SHARES`` equal shares (map-side combined) tells in which
    share each group reaches its target: rows of earlier shares are taken, later ones are
    not, and only that share is ranked, so no task sorts a group."""
    if target <= 0:
        return df.limit(0)
    groups, keys = ([x] if isinstance(x, str) else list(x) for x in (group, key))
    rows = df.withColumn("__u", hash_uniform(seed, *keys)).withColumn(
        "__share", F.floor(F.col("__u") * SHARES).cast("int"))
    before = Window.partitionBy(*groups).orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    cut = (rows.groupBy(*groups, "__share").agg(F.count(F.lit(1)).alias("__n"))
           .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
           .where((F.col("__before") < target) & (F.col("__before") + F.col("__n") >= target))
           .select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__share").alias("__cut"),
                   (F.lit(target) - F.col("__before")).alias("__need")))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    placed = rows.join(cut, same, "left").drop(*[f"__g{i}" for i in range(len(groups))])
    sure = placed.where(F.col("__cut").isNull() | (F.col("__share") < F.col("__cut")))
    last = placed.where(F.col("__share") == F.col("__cut")).withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*groups).orderBy("__u", *keys)))
    last = last.where(F.col("__rank") <= F.col("__need")).drop("__rank")
    return sure.unionByName(last).drop("__u", "__share", "__cut", "__need")


def quantile_sketch(df: DataFrame, value: str, probabilities, names, accuracy: int = 10_000) -> DataFrame:
    """One row of approximate lower quantiles: ranks are off by at most rows / accuracy.

    The sketch is merged from partial ones of bounded size, so nothing is sorted or
    shuffled but sketches; below ``accuracy`` rows it is exact."""
    q = df.agg(F.approx_percentile(value, F.array(*[F.lit(p) for p in probabilities]), F.lit(accuracy)).alias("q"))
    return q.select(*[F.get("q", i).alias(n) for i, n in enumerate(names)])
