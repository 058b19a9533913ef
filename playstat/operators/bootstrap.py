"""Bootstrap confidence interval of a difference of two rates.

For 0/1 data the mean of a resample of size n is exactly Binomial(n, p)/n, so a
replicate needs two binomial draws, not n row draws. A draw is the inverse of the
binomial distribution at a uniform from md5(seed:replicate:group), so replicates depend
on nothing but their number: not on partitioning, retries or the engine. The
distribution is a table of the values within ``TAIL`` standard deviations of the mean
(about 20 sqrt(n) rows); draws and table are merged in one ordered scan per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playstat.functions.tails import hash_uniform

N_BOOTSTRAP = 2000          # fixed values: replicates and seed of the analyses
SEED = 42
CI_LOW, CI_HIGH = 0.025, 0.975
TAIL = 10                   # standard deviations that the table reaches (and as many values)


def binomial_table(groups: DataFrame) -> DataFrame:
    """(g, k, cdf) from (g, n, p): the distribution of Binomial(n, p) around its mean.

    Terms follow from each other by their ratio; they are summed as logarithms from the
    lowest one and normalised. A rate of 0 or 1 gives its only value."""
    n, p = F.col("n"), F.col("p")
    sd = F.sqrt(n * p * (1 - p))
    some = groups.where((n > 0) & p.isNotNull()).withColumns({
        "lo": F.greatest(F.lit(0), F.floor(n * p - TAIL * sd - TAIL)).cast("long"),
        "hi": F.least(n, F.ceil(n * p + TAIL * sd + TAIL)).cast("long")})
    sure = (p <= 0) | (p >= 1)
    some = some.withColumns({"lo": F.when(sure, F.round(n * p).cast("long")).otherwise(F.col("lo")),
                             "hi": F.when(sure, F.round(n * p).cast("long")).otherwise(F.col("hi"))})
    rows = some.withColumn("k", F.explode(F.sequence("lo", "hi")))
    ratio = F.when(F.col("k") == F.col("lo"), F.lit(0.0)).otherwise(
        F.log((n - F.col("k") + 1).cast("double") / F.col("k") * p / (1 - p)))
    upto = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    weight = rows.withColumn("weight", F.exp(F.sum(ratio).over(upto)))
    share = F.sum("weight").over(upto) / F.sum("weight").over(Window.partitionBy("g"))
    return weight.select("g", "k", F.when(F.col("k") == F.col("hi"), F.lit(1.0)).otherwise(share).alias("cdf"))


def binomial_draws(groups: DataFrame, b: int, seed: int) -> DataFrame:
    """(g, id, x): for each replicate the smallest value whose cdf reaches its uniform."""
    table = binomial_table(groups).select("g", F.lit(None).cast("long").alias("id"), F.col("cdf").alias("at"), "k")
    draws = (groups.select("g").crossJoin(groups.sparkSession.range(b))              # two groups
             .select("g", "id", hash_uniform(seed, "id", "g").alias("at"), F.lit(None).cast("long").alias("k")))
    # table rows from a draw on; at an equal value the table row counts
    onward = Window.partitionBy("g").orderBy(F.desc("at"), F.desc_nulls_last("k")).rowsBetween(
        Window.unboundedPreceding, 0)
    return (table.unionByName(draws).withColumn("x", F.min("k").over(onward))
            .where(F.col("id").isNotNull()).select("g", "id", "x"))


def bootstrap_rate_diff(counts: DataFrame, b: int = N_BOOTSTRAP, seed: int = SEED) -> DataFrame:
    """``counts``: one row with n1, k1, n2, k2 (trials and successes of two groups).
    Returns one row: observed diff (k1/n1 - k2/n2), ci_low, ci_high (sorted
    replicate diffs at 0-based positions floor(0.025 B) and floor(0.975 B))."""
    group = lambda g: F.struct(F.lit(g).alias("g"), F.col(f"n{g}").cast("long").alias("n"),
                               F.try_divide(f"k{g}", f"n{g}").alias("p"))
    groups = counts.select(F.explode(F.array(group(1), group(2))).alias("of")).select("of.*")
    rate = lambda g: F.max(F.when(F.col("g") == g, F.col("x") / F.col("n")))
    diffs = (binomial_draws(groups, b, seed).join(F.broadcast(groups), "g")          # two rows
             .groupBy("id").agg((rate(1) - rate(2)).alias("diff")).where(F.col("diff").isNotNull()))
    lo, hi = int(b * CI_LOW), int(b * CI_HIGH)
    ci = diffs.agg(F.sort_array(F.collect_list("diff")).alias("d"))  # B values, bounded by b
    # ``get`` is NULL when degenerate groups left no replicate
    ci = ci.select(F.get("d", lo).alias("ci_low"), F.get("d", hi).alias("ci_high"))
    obs = counts.select((F.try_divide("k1", "n1") - F.try_divide("k2", "n2")).alias("diff"))
    return obs.crossJoin(ci)                                         # one-row frames
