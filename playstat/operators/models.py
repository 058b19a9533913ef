"""Standardisation, interaction feature and logistic regression (Newton's method)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playstat.functions.tails import normal_two_sided_p
from playstat.session import cut_lineage

NEWTON_PASSES = 25          # passes over the data, at most
NEWTON_STEP = 1e-10         # the fit ends when no coefficient moves further than this


def zscore_stats(df: DataFrame, cols) -> DataFrame:
    """One row: <c>_mean and <c>_std (sample) for each column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std")]
    return df.agg(*aggs)


def add_zscores(df: DataFrame, cols, prefix: str = "s_") -> DataFrame:
    """(x - mean) / std for each column; stats come from a broadcast one-row frame."""
    st = zscore_stats(df, cols)
    d = df.crossJoin(F.broadcast(st))
    for c in cols:
        d = d.withColumn(prefix + c, F.try_divide(F.col(c).cast("double") - F.col(f"{c}_mean"),
                                                  F.col(f"{c}_std")))
    return d.drop(*[f"{c}_{s}" for c in cols for s in ("mean", "std")])


def design(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """Weighted design rows (features array<double>, label, w): 1, z(a), z(b), z(a) z(b).

    Identical (a, b, label) rows are one row with their number as weight (map-side
    combined); means and sample standard deviations are weighted sums over them."""
    h = (df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"),
                   F.col(label).cast("double").alias("label")).dropna()
         .groupBy("a", "b", "label").agg(F.count(F.lit(1)).cast("double").alias("w")))
    h = cut_lineage(h)                               # read by the statistics and by the design
    n = F.sum("w")
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / n
    st = h.agg(mean("a").alias("ma"), mean("b").alias("mb"), n.alias("n"))
    st = h.crossJoin(F.broadcast(st)).agg(*[                                          # one-row side
        x for c in "ab" for x in (
            F.max(f"m{c}").alias(f"m{c}"),
            F.sqrt(F.try_divide(F.sum(F.col("w") * (F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}"))),
                                F.max("n") - 1)).alias(f"s{c}"))])
    z = lambda c: F.try_divide(F.col(c) - F.col(f"m{c}"), F.col(f"s{c}"))
    d = h.crossJoin(F.broadcast(st)).select(z("a").alias("za"), z("b").alias("zb"), "label", "w").dropna()
    return d.select(F.array(F.lit(1.0), "za", "zb", F.col("za") * F.col("zb")).alias("features"), "label", "w")


def newton_logit(rows: DataFrame, size: int, passes: int = NEWTON_PASSES):
    """Maximum-likelihood logistic fit of (features, label, w) by Newton's method.

    Each pass is one aggregate of the gradient and the upper triangle of the information
    over the weighted rows; only these sums reach the driver, which solves a system of
    ``size`` unknowns. Returns (coefficients, covariance), or None without a maximum
    (one label only, dependent features, separated labels)."""
    x = [F.col("features")[i] for i in range(size)]
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    beta = np.zeros(size)
    for _ in range(passes):
        eta = sum((x[i] * F.lit(float(beta[i])) for i in range(1, size)), F.lit(float(beta[0])))
        p = 1.0 / (1.0 + F.exp(-eta))
        v = F.col("w") * p * (1 - p)
        sums = rows.agg(*[F.sum(F.col("w") * (F.col("label") - p) * x[i]).alias(f"g{i}") for i in range(size)],
                        *[F.sum(v * x[i] * x[j]).alias(f"h{i}{j}") for i, j in upper],
                        F.min("label").alias("low"), F.max("label").alias("high")).first()
        if sums["low"] is None or sums["low"] == sums["high"]:
            return None
        info = np.zeros((size, size))
        for i, j in upper:
            info[i, j] = info[j, i] = sums[f"h{i}{j}"]
        if not np.isfinite(info).all() or np.linalg.cond(info) > 1e14:
            return None
        covariance = np.linalg.inv(info)             # at the coefficients of this pass
        move = covariance @ np.array([sums[f"g{i}"] for i in range(size)])
        beta = beta + move
        if np.abs(move).max() < NEWTON_STEP:
            return beta, covariance
    return None


def logit_interaction(df: DataFrame, a: str = "is_organic", b: str = "track_length_seconds",
                      label: str = "listen_plus") -> DataFrame:
    """Fits label ~ 1 + z(a) + z(b) + z(a) z(b) on all complete rows: a row per
    coefficient (name, coef, wald_z, p). Where nothing can be fitted they are NULL."""
    names = ["intercept", f"s_{a}", f"s_{b}", "interaction"]
    fit = newton_logit(cut_lineage(design(df, a, b, label)), len(names))
    rows = [(n, None, None) for n in names] if fit is None else [
        (n, float(c), float(c / np.sqrt(v))) for n, c, v in zip(names, fit[0], np.diag(fit[1]))]
    made = df.sparkSession.createDataFrame(rows, "name string, coef double, wald_z double")
    return made.withColumn("p", normal_two_sided_p("wald_z"))
