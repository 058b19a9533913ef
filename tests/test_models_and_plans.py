import math

import pytest
from pyspark.sql import functions as F

from playstat.operators.models import logit_interaction
from playstat.operators.sampling import hash_sample, sample_to_target


def test_logit_recovers_planted_coefficients(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    n = 20000
    org = rng.integers(0, 2, n)
    length = rng.uniform(60, 600, n)
    zo = (org - org.mean()) / org.std(ddof=1)
    zl = (length - length.mean()) / length.std(ddof=1)
    eta = 0.3 + 0.5 * zo - 0.8 * zl + 0.4 * zo * zl
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(c)) for a, b, c in zip(org, length, y)],
                               "is_organic int, track_length_seconds double, listen_plus int")
    coefs = {r["name"]: tuple(r)[1:] for r in logit_interaction(df).collect()}
    assert coefs["s_is_organic"][0] == pytest.approx(0.5, abs=0.1)
    assert coefs["s_track_length_seconds"][0] == pytest.approx(-0.8, abs=0.1)
    assert coefs["interaction"][0] == pytest.approx(0.4, abs=0.1)
    assert coefs["interaction"][2] < 1e-6


def test_hash_sample_is_partition_independent(spark):
    df = spark.range(5000).withColumnRenamed("id", "uid")
    a = {r.uid for r in hash_sample(df, "uid", 0.3).collect()}
    b = {r.uid for r in hash_sample(df.repartition(7), "uid", 0.3).collect()}
    assert a == b and 1300 < len(a) < 1700
    few = spark.range(1000).withColumnRenamed("id", "uid")
    for seed in range(100):
        assert sample_to_target(few, "uid", 20, seed).count() == 20
    assert sample_to_target(few, "uid", 5000).count() == 1000


def test_sessions_plan_has_no_single_partition_exchange(spark):
    from playstat.sources.adapters import events_bundle
    from playstat.operators.enrich import clocked
    from playstat.operators.sessions import sessionize, session_positions
    b = events_bundle(spark, "/root/testdata/sf0.001", with_embeddings=False)
    s = session_positions(sessionize(clocked(b, "multi_event"), b.order_cols, chunk_col=None),
                          b.order_cols, chunk_col=None)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_registered_queries_have_oracles_or_are_rows_only():
    from playstat.plans.hypotheses import HYPOTHESIS_QUERIES
    from playstat.plans.oracle import ORACLE
    from playstat.plans.queries import REGISTRY
    q, o = {**REGISTRY, **HYPOTHESIS_QUERIES}, ORACLE
    assert set(o) <= set(q)
    assert len(o) >= 50


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 2 and "lp_rate" in df.columns


def test_every_registered_query_runs(spark):
    from playstat.plans.hypotheses import HYPOTHESIS_QUERIES
    from playstat.plans.queries import REGISTRY
    failed = {}
    for key, f in {**REGISTRY, **HYPOTHESIS_QUERIES}.items():
        try:
            f(spark, "/root/testdata/sf0.001").collect()
        except Exception as e:  # noqa: BLE001
            failed[key] = str(e)[:200]
    assert not failed


def test_sample_to_target_by_group(spark):
    import hashlib
    from playstat.operators.sampling import sample_to_target_by_group
    rows = [(i, ["a", "b", None][0 if i % 10 else 1 + i % 3 % 2]) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g string")
    u = lambda k: int(hashlib.md5(f"7:{k}".encode()).hexdigest()[:8], 16)
    for target in (0, 1, 40, 150, 5000):
        got = {(r.k, r.g) for r in sample_to_target_by_group(df.repartition(5), "g", "k", target, 7).collect()}
        want = {x for g in {g for _, g in rows} for x in sorted((r for r in rows if r[1] == g), key=lambda r: (u(r[0]), r[0]))[:target]}
        assert got == want


def test_newton_equals_spark_ml(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from playstat.operators.models import design, newton_logit
    r = np.random.default_rng(3)
    data = [(int(a), float(b), int(y)) for a, b, y in zip(r.integers(0, 2, 4000), r.uniform(0, 9, 4000), r.integers(0, 2, 4000))]
    rows = design(spark.createDataFrame(data, "a int, b double, y int"), "a", "b", "y").cache()
    beta, _ = newton_logit(rows, 4)
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", maxIter=300, tol=1e-12, standardization=False).fit(
        rows.withColumn("x", array_to_vector(F.slice("features", 2, 3))))
    assert np.allclose(beta, [fit.intercept, *fit.coefficients.toArray()], atol=1e-6)
    same = spark.createDataFrame([(a, b, 1) for a, b, _ in data], "a int, b double, y int")
    assert newton_logit(design(same, "a", "b", "y"), 4) is None                     # one label only
    split = spark.createDataFrame([(a, b, int(b > 4)) for a, b, _ in data], "a int, b double, y int")
    assert newton_logit(design(split, "a", "b", "y"), 4) is None                    # separated
