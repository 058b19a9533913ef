"""2x2 contingency tables and closed-form tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playstat.functions.tails import chi2_df1_p, normal_two_sided_p

FISHER_CLIP = 0.9999        # fixed value: |r| is clipped before atanh


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contingency(df: DataFrame, outcome: str, group: str = "is_organic") -> DataFrame:
    """One row of four counts: rows = group (0 recommended, 1 organic),
    columns = outcome (0 negative, 1 positive)."""
    g, o = F.col(group), F.col(outcome)
    return df.agg(F.count_if((g == 0) & (o == 0)).alias("rec_neg"),
                  F.count_if((g == 0) & (o == 1)).alias("rec_pos"),
                  F.count_if((g == 1) & (o == 0)).alias("org_neg"),
                  F.count_if((g == 1) & (o == 1)).alias("org_pos"))


def chi2_2x2(ct: DataFrame, yates: bool = False) -> DataFrame:
    """Pearson chi-square (df 1), p and odds ratio rec/org on a ``contingency`` row.
    A zero margin gives NULL chi2/p; OR is NULL unless rec_neg * org_pos > 0."""
    a, b = F.col("rec_pos").cast("double"), F.col("rec_neg").cast("double")
    c, d = F.col("org_pos").cast("double"), F.col("org_neg").cast("double")
    n = a + b + c + d
    den = (a + b) * (c + d) * (a + c) * (b + d)
    diff = F.abs(a * d - b * c)
    if yates:
        diff = F.greatest(diff - n / 2.0, F.lit(0.0))
    chi2 = F.when(den > 0, n * diff * diff / den)
    return (ct.withColumn("chi2", chi2)
              .withColumn("p_value", chi2_df1_p("chi2"))
              .withColumn("odds_ratio_rec_over_org", F.when(b * c > 0, a * d / (b * c))))


def fisher_z(r1, r2, n1, n2) -> tuple[Column, Column]:
    """(z, two-sided p) comparing two correlations."""
    clip = lambda r: F.when(_c(r).isNotNull(),  # greatest/least skip NULL
                            F.least(F.lit(FISHER_CLIP), F.greatest(F.lit(-FISHER_CLIP), _c(r))))
    ok = (_c(n1) > 3) & (_c(n2) > 3)
    se = F.sqrt(F.try_divide(F.lit(1.0), _c(n1) - 3.0) + F.try_divide(F.lit(1.0), _c(n2) - 3.0))
    z = F.when(ok, (F.atanh(clip(r1)) - F.atanh(clip(r2))) / se)
    return z, normal_two_sided_p(z)


def two_proportion_z(p1, n1, p2, n2) -> tuple[Column, Column]:
    """Pooled two-proportion z of (p1 - p2) and its two-sided p; zero SE -> NULL."""
    n1d, n2d = _c(n1).cast("double"), _c(n2).cast("double")
    # ANSI mode: x / 0 raises, so every count divisor goes through try_divide
    pooled = F.try_divide(_c(p1) * n1d + _c(p2) * n2d, n1d + n2d)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1d) + F.try_divide(F.lit(1.0), n2d)))
    z = F.when(se > 0, (_c(p1) - _c(p2)) / se)
    return z, normal_two_sided_p(z)


def bonferroni(p, m: int) -> Column:
    return F.least(_c(p) * m, F.lit(1.0))
