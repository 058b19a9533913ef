"""Tail probabilities as Column expressions, plus a deterministic hash uniform.

Normal and chi-square(1) tails use a rational erfc approximation (relative error
about 1e-7), the Student-t tail a fixed quadrature; all p-values are computed inside
the JVM on the final metric rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: erfc rational approximation, t = 1 / (1 + |z| / 2)
ERFC_COEFFS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
SQRT2 = math.sqrt(2.0)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def erfc(z) -> Column:
    z = _c(z)
    az = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * az)
    poly = F.lit(ERFC_COEFFS[-1])
    for a in reversed(ERFC_COEFFS[1:-1]):
        poly = F.lit(a) + t * poly
    ans = t * F.exp(-az * az + F.lit(ERFC_COEFFS[0]) + t * poly)
    return F.when(z >= 0, ans).otherwise(F.lit(2.0) - ans)


def normal_two_sided_p(z) -> Column:
    return erfc(F.abs(_c(z)) / SQRT2)


def normal_lower_p(z) -> Column:
    """P(Z <= z)."""
    return F.lit(0.5) * erfc(-_c(z) / SQRT2)


def chi2_df1_p(chi2) -> Column:
    return erfc(F.sqrt(_c(chi2) / 2.0))


# ---- Student t ------------------------------------------------------------

QUADRATURE_PANELS = 8000      # Simpson panels of the tail integral
TAIL_WIDTHS = 40.0            # standard widths that the integral covers (the rest is < 1e-300)
GAMMA_SHIFT = 16              # the ratio of gammas is expanded at an argument this much larger


def _half_gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a), a > 0: the asymptotic series of its logarithm at
    a + GAMMA_SHIFT, walked back by the recurrence of the gamma function."""
    far = a + GAMMA_SHIFT
    series = (F.lit(0.5) * F.log(far) - F.lit(1.0) / (8 * far) + F.lit(1.0) / (192 * far * far * far)
              - F.lit(1.0) / (640 * far * far * far * far * far))
    back = F.lit(1.0)
    for k in range(GAMMA_SHIFT):
        back = back * ((a + k) / (a + k + 0.5))
    return F.exp(series) * back


def student_t_two_sided_p(t, df) -> Column:
    """Two-sided tail P(|T| >= |t|); NULL or NaN in, or df < 1 -> NULL.

    With t = sqrt(df) tan(theta) the tail is an integral of cos(theta) ** (df - 1), done
    by Simpson's rule on a fixed number of panels (a bounded ``aggregate``)."""
    t, df = _c(t).cast("double"), _c(df).cast("double")
    low = F.atan(F.abs(t) / F.sqrt(df))
    high = F.least(F.lit(math.pi / 2), low + F.lit(TAIL_WIDTHS) / F.sqrt(df))
    step = (high - low) / QUADRATURE_PANELS

    def add(acc, i):
        sin = F.sin(low + step * i)
        weight = F.when((i == 0) | (i == QUADRATURE_PANELS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        # sin = 1 only at the end of the range, where the integrand is 0 (or 1, for df = 1)
        return acc + weight * F.when(df == 1.0, F.lit(1.0)).when(sin >= 1.0, F.lit(0.0)).otherwise(
            F.exp((df - 1.0) * F.lit(0.5) * F.log1p(-sin * sin)))

    integral = F.aggregate(F.sequence(F.lit(0), F.lit(QUADRATURE_PANELS)), F.lit(0.0), add) * step / 3.0
    p = F.lit(2.0 / math.sqrt(math.pi)) * _half_gamma_ratio(df / 2.0) * integral
    none = t.isNull() | df.isNull() | F.isnan(t) | F.isnan(df) | (df < 1)        # least() skips NULLs
    return F.when(none, F.lit(None).cast("double")).when(
        F.abs(t) == float("inf"), F.lit(0.0)).otherwise(F.least(F.lit(1.0), p))


# ---- deterministic, partition-independent uniform ----------------------

def hash_uniform(seed: int, *keys) -> Column:
    """u in [0,1) from md5(seed:key...); identical to the DuckDB spelling
    ('0x'||substr(md5(s),1,8))::BIGINT / 4294967296.0."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit(":"), _c(k).cast("string")]
    h = F.substring(F.md5(F.concat(*parts)), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)
