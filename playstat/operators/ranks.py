"""Rank statistics on full data: average ranks, Mann-Whitney U, Spearman rho.

Ranks are computed on the *value histogram* (one row per distinct value, built
with a map-side-combined aggregate), and the running count over the histogram
uses range-bucketed prefix sums (``prefix.global_prefix``), so neither ties nor
high cardinality put all rows in one task. Only one metric row per test comes
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playstat.functions.tails import normal_lower_p, normal_two_sided_p, student_t_two_sided_p
from playstat.operators.prefix import global_prefix
from playstat.session import cut_lineage


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value_histogram(df: DataFrame, value: str, group: str | None = None,
                    x_value=0, y_value=1, part=()) -> DataFrame:
    """(part..., value, n, n_x, n_y); NULL values dropped."""
    d = df.filter(F.col(value).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    if group is not None:
        aggs += [F.count_if(F.col(group) == x_value).alias("n_x"),
                 F.count_if(F.col(group) == y_value).alias("n_y")]
    return d.groupBy(*part, value).agg(*aggs)


def avg_ranks(hist: DataFrame, value: str, part=(), weight: str = "n") -> DataFrame:
    """Adds ``avg_rank`` (1-based, ties averaged) to a value histogram."""
    r = global_prefix(hist, value, weight, "__before", part=part)
    return r.withColumn("avg_rank", F.col("__before") + (F.col(weight) + 1) / 2.0).drop("__before")


def mann_whitney(df: DataFrame, value: str, group: str, x_value=0, y_value=1,
                 tie_correction: bool = True) -> DataFrame:
    """One row: n1, n2, u1 (U of the x group), z, p_less (x tends lower),
    p_two_sided and rank-biserial r = 2 U1/(n1 n2) - 1 (negative -> x lower).
    Rows of other groups are ignored. Zero variance -> NULL z and p."""
    hist = value_histogram(df.filter(F.col(group).isin(x_value, y_value)), value, group, x_value, y_value)
    # the histogram is read three times below: materialise it once (reliably)
    r = avg_ranks(cut_lineage(hist), value)
    s = r.agg(F.sum("n_x").cast("double").alias("n1"), F.sum("n_y").cast("double").alias("n2"),
              F.sum(F.col("n_x") * F.col("avg_rank")).alias("r1"),
              F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("tie"))
    nn = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12.0 * (nn + 1)
    if tie_correction:
        var = F.col("n1") * F.col("n2") / 12.0 * ((nn + 1) - F.try_divide(F.col("tie"), nn * (nn - 1)))
    s = (s.withColumn("u1", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0)
          .withColumn("__sd", F.when(var > 0, F.sqrt(var)))
          .withColumn("z", (F.col("u1") - F.col("n1") * F.col("n2") / 2.0) / F.col("__sd"))
          .withColumn("p_less", normal_lower_p("z"))
          .withColumn("p_two_sided", normal_two_sided_p("z"))
          .withColumn("r_rank_biserial", F.try_divide(2.0 * F.col("u1"), F.col("n1") * F.col("n2")) - 1.0))
    return s.select(F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"),
                    "u1", "z", "p_less", "p_two_sided", "r_rank_biserial")


def spearman(df: DataFrame, x: str, y: str, part=()) -> DataFrame:
    """Spearman rho of (x, y) over complete rows, per ``part``: one row per part
    with n, rho, t and the two-sided Student-t p (rho = +-1 -> p = 0; a constant
    column -> NULL rho and p, no error).

    Pairs are first collapsed to a (x, y, count) histogram. y is ranked on its own
    histogram; its rank sums are gathered per value of x, and x is ranked on that
    frame, so no rank is joined back to the pairs of x. Every part needs a row of
    its own on one machine: parts are few. Runs jobs while the query is built."""
    part = list(part)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = cut_lineage(d.groupBy(*part, x, y).agg(F.count(F.lit(1)).alias("c")))
    ys = avg_ranks(pairs.groupBy(*part, y).agg(F.sum("c").alias("n")), y, part)
    ry = ys.select(*part, y, F.col("avg_rank").alias("ry"))
    # rank sums of y per value of x: x is ranked on the frame that carries them
    xs = pairs.join(ry, part + [y]).groupBy(*part, x).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("ry")).alias("s"))
    xs = avg_ranks(cut_lineage(xs), x, part)
    n, r = F.col("n").cast("double"), F.col("avg_rank")
    sx = xs.groupBy(*part).agg(F.sum("n").alias("n"), F.sum(n * r * r).alias("xx"), F.sum(r * F.col("s")).alias("xy"))
    sy = ys.groupBy(*part).agg(F.sum(n * r * r).alias("yy"))
    s = sx.join(F.broadcast(sy), part) if part else sx.crossJoin(F.broadcast(sy))      # one row per part
    total = F.col("n").cast("double")
    centre = total * ((total + 1) / 2.0) * ((total + 1) / 2.0)       # n times the squared mean rank
    s = (s.withColumn("sxy", F.col("xy") - centre).withColumn("sxx", F.col("xx") - centre)
         .withColumn("syy", F.col("yy") - centre))
    eps = F.col("n").cast("double") * F.col("n") * F.col("n") * 1e-14     # cancellation of equal sums
    rho = F.when((F.col("sxx") > eps) & (F.col("syy") > eps),
                 F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    rho = F.when(rho.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), rho)))  # greatest skips NULL
    s = s.withColumn("rho", rho).withColumn(
        "t", F.when(F.abs("rho") < 1.0,
                    F.col("rho") * F.sqrt((F.col("n") - 2.0) / (1.0 - F.col("rho") ** 2))))
    return s.select(*part, "n", "rho", "t")


def with_t_pvalue(s: DataFrame) -> DataFrame:
    """Adds the two-sided Student-t p (df = n - 2) to a ``spearman`` result."""
    p = student_t_two_sided_p(F.col("t"), F.col("n") - 2)
    return s.withColumn("p_value", F.when(F.abs("rho") == 1.0, F.lit(0.0))
                        .when(F.col("n") > 2, p))


def exact_median(df: DataFrame, value: str, part=(), out: str = "median") -> DataFrame:
    """Interpolated median (= percentile_cont(0.5)) of ``value`` per ``part`` (few parts).

    It comes from the value histogram with ranged prefix counts, so no task holds a
    group's values: the two middle ranks floor((n-1)/2) and ceil((n-1)/2) are located
    in the cumulative counts and interpolated."""
    part = list(part)
    h = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*part, value)
                    .agg(F.count(F.lit(1)).alias("__c")))
    tot = h.groupBy(*part).agg(F.sum("__c").alias("__n"))                     # one row per part
    h = global_prefix(h, value, "__c", "__before", part=part)
    h = h.join(F.broadcast(tot), part) if part else h.crossJoin(F.broadcast(tot))
    pos = (F.col("__n") - 1) / 2.0
    lo, hi = F.floor(pos), F.ceil(pos)
    covers = lambda r: (F.col("__before") <= r) & (r < F.col("__before") + F.col("__c"))
    g = h.groupBy(*part).agg(F.min(F.when(covers(lo), F.col(value))).alias("__lo"),
                             F.min(F.when(covers(hi), F.col(value))).alias("__hi"),
                             F.first("__n").alias("__n"))
    frac = (F.col("__n") - 1) / 2.0 - F.floor((F.col("__n") - 1) / 2.0)
    return g.select(*part, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * frac).cast("double").alias(out))
