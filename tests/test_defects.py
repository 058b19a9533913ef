"""Regression tests for the documented fixes and invariances."""

import pytest
from pyspark.sql import functions as F

from playstat.operators import interactions as I
from playstat.operators import ranks as R
from playstat.operators import tests as TS
from playstat.plans import queries as Q
from playstat.plans.context import Context, Params
from playstat.sources.adapters import events_bundle


def test_k1_rank_biserial_sign(spark):
    # recommended (0) clearly lower -> r < 0 and small p_less
    df = spark.createDataFrame([(float(v), 0) for v in range(50)] + [(float(v), 1) for v in range(40, 90)],
                               "v double, g int")
    m = R.mann_whitney(df, "v", "g", 0, 1).first()
    assert m.r_rank_biserial < 0 and m.p_less < 0.05


def test_k6_last_is_deterministic(spark):
    df = spark.createDataFrame([(1, 1, 3, 1, 0.0, 0), (1, 1, 1, 0, 0.0, 0), (1, 1, 2, 0, 0.0, 0)],
                               "uid long, item_id long, t long, is_organic int, played_ratio_pct double, listen_plus int")
    for n in (1, 3):
        r = I.pair_agg(df.repartition(n), ["t"]).first()
        assert r.is_organic == 1 and r.n_listens == 3


def test_k14_empty_group_gives_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "v double, g int")
    m = R.mann_whitney(df, "v", "g", 0, 1).first()
    assert m.n2 == 0 and m.z is None and m.p_less is None
    ct = spark.createDataFrame([(5, 5, 0, 0)], "rec_neg long, rec_pos long, org_neg long, org_pos long")
    r = TS.chi2_2x2(ct).first()
    assert r.chi2 is None and r.p_value is None
    z, p = TS.two_proportion_z(F.lit(None).cast("double"), F.lit(0), F.lit(0.2), F.lit(10))
    assert spark.range(1).select(z.alias("z"), p.alias("p")).first() == (None, None)


def test_results_invariant_under_repartition(spark):
    b = events_bundle(spark, "/root/testdata/sf0.001")
    ctx1 = Context.from_bundle(spark, b, Params(session_gap=86_400, window_size=20, window_step=10))
    b8 = b.with_(listens=b.listens.repartition(8), multi_event=b.multi_event.repartition(5),
                 dislikes=b.dislikes.repartition(3))
    ctx2 = Context.from_bundle(spark, b8, Params(session_gap=86_400, window_size=20, window_step=10))
    for f in (Q.chi2_dislike, Q.session_fatigue, Q.window_entropy, Q.spearman_by_group):
        assert sorted(map(tuple, f(ctx1).collect())) == sorted(map(tuple, f(ctx2).collect()))


def test_zero_counts_do_not_raise_under_ansi(spark):
    one = spark.range(1)
    z, p = TS.two_proportion_z(F.lit(0.1), F.lit(0), F.lit(0.2), F.lit(0))
    assert one.select(z.alias("z"), p.alias("p")).first() == (None, None)
    z, p = TS.fisher_z(F.lit(0.1), F.lit(0.2), F.lit(3), F.lit(50))
    assert one.select(z.alias("z")).first().z is None
    single = spark.createDataFrame([(1.0, 0)], "v double, g int")
    assert R.mann_whitney(single, "v", "g", 0, 1).first().p_two_sided is None
    from playstat.operators.bootstrap import bootstrap_rate_diff
    c = spark.createDataFrame([(0, 0, 10, 3)], "n1 long, k1 long, n2 long, k2 long")
    r = bootstrap_rate_diff(c, b=50).first()
    assert r.diff is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    from playstat.operators.skew import salted_join
    big = spark.createDataFrame([(0 if i % 3 else i % 50, i) for i in range(3000)], "k long, v long")
    small = spark.createDataFrame([(k, k * 10) for k in range(0, 50, 2)], "k long, w long")
    a = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    b = sorted(map(tuple, salted_join(big, small, "k", how, hot_rows=100, salt=8).collect()), key=str)
    assert a == b
