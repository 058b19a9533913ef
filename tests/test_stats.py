import math

import pytest

from pyspark.sql import functions as F

from playstat.functions.tails import student_t_two_sided_p
from playstat.operators import ranks as R
from playstat.operators import tests as TS
from playstat.operators.bootstrap import bootstrap_rate_diff
from tests.conftest import rows


def plain_t_tail(t, df):
    """Midpoint sums of the density over log-spaced pieces."""
    import numpy as np
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) if df < 1e9 else 1 / math.sqrt(2 * math.pi)
    edges = abs(t) + np.concatenate(([0.0], np.geomspace(1e-6, 1e14, 2_000_000)))
    mid, width = (edges[1:] + edges[:-1]) / 2, np.diff(edges)
    return min(1.0, 2 * c * float(np.sum(np.exp(-(df + 1) / 2 * np.log1p(mid * mid / df)) * width)))


def _groups(spark, x, y):
    data = [(float(v), 0) for v in x] + [(float(v), 1) for v in y]
    return spark.createDataFrame(data, "v double, g int")


def test_mann_whitney_basic_and_swapped(spark):
    m = R.mann_whitney(_groups(spark, [1, 2], [3, 4]), "v", "g").first()
    assert m.u1 == 0 and m.r_rank_biserial == -1.0 and m.p_less < 0.5
    m = R.mann_whitney(_groups(spark, [3, 4], [1, 2]), "v", "g").first()
    assert m.u1 == 4 and m.r_rank_biserial == 1.0


def test_mann_whitney_all_ties(spark):
    m = R.mann_whitney(_groups(spark, [1, 1], [1, 1]), "v", "g").first()
    assert m.u1 == 2 and m.r_rank_biserial == 0.0 and m.p_two_sided is None


def test_mann_whitney_u_sum_property(spark):
    import random
    rnd = random.Random(1)
    x = [rnd.randint(0, 30) for _ in range(200)]
    y = [rnd.randint(5, 40) for _ in range(150)]
    a = R.mann_whitney(_groups(spark, x, y), "v", "g").first()
    b = R.mann_whitney(_groups(spark, y, x), "v", "g").first()
    assert a.u1 + b.u1 == pytest.approx(200 * 150)
    # brute force U1
    u = sum((xi > yj) + 0.5 * (xi == yj) for xi in x for yj in y)
    assert a.u1 == pytest.approx(u)


def test_avg_ranks_sum(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 2, 5, 5, 5, 9]], "v double")
    h = R.avg_ranks(R.value_histogram(df, "v"), "v")
    got = {r.v: r.avg_rank for r in h.collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0, 5.0: 6.0, 9.0: 8.0}
    assert sum(got[k] * c for k, c in {1.0: 1, 2.0: 2, 3.0: 1, 5.0: 3, 9.0: 1}.items()) == 8 * 9 / 2


def test_chi2_hand_case(spark):
    ct = spark.createDataFrame([(90, 10, 70, 30)], "rec_neg long, rec_pos long, org_neg long, org_pos long")
    r = TS.chi2_2x2(ct).first()
    assert r.chi2 == pytest.approx(12.5)
    assert r.p_value == pytest.approx(4.0695e-4, rel=1e-4)
    assert r.odds_ratio_rec_over_org == pytest.approx(7 / 27)


def test_chi2_transpose_invariant_and_degenerate(spark):
    a = spark.createDataFrame([(40, 12, 33, 25)], "rec_neg long, rec_pos long, org_neg long, org_pos long")
    b = spark.createDataFrame([(40, 33, 12, 25)], "rec_neg long, rec_pos long, org_neg long, org_pos long")
    assert TS.chi2_2x2(a).first().chi2 == pytest.approx(TS.chi2_2x2(b).first().chi2)
    z = spark.createDataFrame([(10, 0, 20, 0)], "rec_neg long, rec_pos long, org_neg long, org_pos long")
    r = TS.chi2_2x2(z).first()
    assert r.chi2 is None and r.p_value is None and r.odds_ratio_rec_over_org is None


def test_contingency_counts(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 0)], "is_organic int, y int")
    assert rows(TS.contingency(df, "y")) == [(1, 2, 1, 0)]


def test_spearman_monotone_and_constant(spark):
    df = spark.createDataFrame([(float(x), float(x) ** 3) for x in range(1, 6)], "x double, y double")
    s = R.with_t_pvalue(R.spearman(df, "x", "y")).first()
    assert s.rho == pytest.approx(1.0) and s.p_value == 0.0
    c = spark.createDataFrame([(float(x), 1.0) for x in range(1, 6)], "x double, y double")
    s = R.with_t_pvalue(R.spearman(c, "x", "y")).first()
    assert s.rho is None and s.p_value is None


def test_spearman_matches_pearson_of_ranks(spark):
    import random
    rnd = random.Random(3)
    data = [(float(rnd.randint(0, 10)), float(rnd.randint(0, 3))) for _ in range(300)]
    s = R.spearman(spark.createDataFrame(data, "x double, y double"), "x", "y").first()

    def ranks(v):
        order = sorted(range(len(v)), key=lambda i: v[i])
        r = [0.0] * len(v)
        i = 0
        while i < len(v):
            j = i
            while j + 1 < len(v) and v[order[j + 1]] == v[order[i]]:
                j += 1
            for k in range(i, j + 1):
                r[order[k]] = (i + j) / 2 + 1
            i = j + 1
        return r
    rx, ry = ranks([a for a, _ in data]), ranks([b for _, b in data])
    mx, my = sum(rx) / len(rx), sum(ry) / len(ry)
    num = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    den = math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry))
    assert s.rho == pytest.approx(num / den)


def test_student_t_tail(spark):
    cases = [(2.0, 10.0), (0.0, 5.0), (1.96, 1e6), (-3.3, 4.0), (0.7, 1.0), (12.7, 1.0), (40.0, 2.0), (1e-9, 7.0),
             (5.5, 1e10), (0.3, 3.0), (8.0, 33.0)]
    df = spark.createDataFrame(cases, "t double, df double")
    got = [r.p for r in df.select(student_t_two_sided_p("t", "df").alias("p")).collect()]
    for (t, n), p in zip(cases, got):
        assert p == pytest.approx(plain_t_tail(t, n), rel=1e-7, abs=1e-12), (t, n)
    assert got[0] == pytest.approx(0.07338803, rel=1e-6) and got[1] == pytest.approx(1.0)
    odd = spark.createDataFrame([(float("inf"), 3.0), (None, 3.0), (float("nan"), 3.0), (1.0, 0.5), (1.0, None)], df.schema)
    assert [r.p for r in odd.select(student_t_two_sided_p("t", "df").alias("p")).collect()] == [0.0, None, None, None, None]


def test_fisher_and_two_proportion(spark):
    df = spark.createDataFrame([(0.3, 0.3, 100, 100)], "r1 double, r2 double, n1 long, n2 long")
    z, p = TS.fisher_z("r1", "r2", "n1", "n2")
    r = df.select(z.alias("z"), p.alias("p")).first()
    assert r.z == 0.0 and r.p == pytest.approx(1.0, abs=1e-6)
    z, p = TS.two_proportion_z(F.col("r1"), F.col("n1"), F.col("r2"), F.col("n2"))
    r = df.select(z.alias("z"), p.alias("p")).first()
    assert r.z == 0.0 and r.p == pytest.approx(1.0, abs=1e-6)
    assert df.select(TS.bonferroni(F.lit(0.6), 2)).first()[0] == 1.0


def test_normal_tail_accuracy(spark):
    from playstat.functions.tails import normal_two_sided_p
    df = spark.createDataFrame([(z,) for z in (0.5, 1.96, 3.5, 6.0)], "z double")
    got = [r[0] for r in df.select(normal_two_sided_p("z")).collect()]
    for z, p in zip((0.5, 1.96, 3.5, 6.0), got):
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-7)


def test_bootstrap_ci_positions_and_reproducible(spark):
    c = spark.createDataFrame([(1000, 300, 1000, 200)], "n1 long, k1 long, n2 long, k2 long")
    a = bootstrap_rate_diff(c, b=2000, seed=7).first()
    b = bootstrap_rate_diff(c.repartition(3), b=2000, seed=7).first()
    assert a == b
    assert a.diff == pytest.approx(0.1) and a.ci_low < 0.1 < a.ci_high
    # brute force resampling of the same 0/1 data gives a similar interval
    import numpy as np
    rng = np.random.default_rng(0)
    x1 = np.r_[np.ones(300), np.zeros(700)]
    x2 = np.r_[np.ones(200), np.zeros(800)]
    d = np.sort([rng.choice(x1, 1000).mean() - rng.choice(x2, 1000).mean() for _ in range(2000)])
    assert a.ci_low == pytest.approx(d[50], abs=0.01) and a.ci_high == pytest.approx(d[1950], abs=0.01)


def test_exact_median_matches_percentile(spark):
    import random
    rnd = random.Random(1)
    for n in (1, 2, 3, 10, 501):
        data = [(rnd.randint(0, 2), float(rnd.randint(0, 20))) for _ in range(n)]
        df = spark.createDataFrame(data, "g int, v double")
        got = {r.g: r.median for r in R.exact_median(df, "v", ["g"]).collect()}
        want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
        assert got == want
