"""Analyses on incomplete, degenerate and unordered inputs."""

import math

import pytest
from pyspark.sql import functions as F

from playstat.plans import hypotheses as H
from playstat.plans import queries as Q
from playstat.plans.context import Context, Params
from playstat.sources import schemas as S
from playstat.sources.adapters import events_bundle
from playstat.sources.loader import optional_table

SF = "/root/testdata/sf0.001"
PARAMS = Params(session_gap=86_400, window_size=20, window_step=10)


def write(b, path, tables, seq=True):
    for name in tables:
        df = getattr(b, name)
        cols = getattr(S, name.upper())
        df.select(*cols, *([F.col("event_id").alias("seq")] if seq else [])).write.parquet(f"{path}/{name}.parquet")


ALL_TABLES = ("listens", "likes", "dislikes", "undislikes", "multi_event")


@pytest.fixture(scope="module")
def bundle(spark):
    return events_bundle(spark, SF, with_embeddings=False)


def variants(b):
    one = b.with_(listens=b.listens.withColumn("is_organic", F.lit(1)),
                  dislikes=b.dislikes.withColumn("is_organic", F.lit(1)))
    bare = b.with_(likes=b.likes.limit(0), dislikes=b.dislikes.limit(0), undislikes=b.undislikes.limit(0))
    return {"no embeddings": b, "one group": one, "no likes or dislikes": bare,
            "no rows": b.with_(**{t: getattr(b, t).limit(0) for t in ALL_TABLES})}


@pytest.mark.parametrize("name", ["no embeddings", "one group", "no likes or dislikes", "no rows"])
def test_every_analysis_gives_rows(spark, bundle, name):
    ctx = Context.from_bundle(spark, variants(bundle)[name], PARAMS)
    rows = H.run_all(ctx).collect()
    assert {r.id for r in rows} == {f"H{i}" for i in range(1, 12)}
    if name == "no embeddings":
        h11 = {r.metric: r.value for r in rows if r.id == "H11"}
        assert h11["diversity_p_value"] is None and h11["p_two_sided"] is not None
    if name in ("one group", "no rows"):
        assert not any(r.confirmed for r in rows)
        assert all(r.value is None for r in rows if r.id == "H5")
    assert H.hypothesis_summary(ctx).count() == 12


def test_optional_source_hides_only_absence(spark, tmp_path):
    assert optional_table(spark, str(tmp_path), "embeddings", S.EMBEDDINGS) is None
    (tmp_path / "embeddings.parquet").mkdir()
    with pytest.raises(Exception):
        optional_table(spark, str(tmp_path), "embeddings", S.EMBEDDINGS)


def test_deltas_need_an_order(spark, bundle, tmp_path):
    write(bundle, str(tmp_path), ALL_TABLES)
    with pytest.raises(ValueError, match="order_cols"):
        Context.from_folder(spark, str(tmp_path))
    with pytest.raises(ValueError, match="missing columns"):
        Context.from_folder(spark, str(tmp_path), order_cols=("nope",))


def test_results_do_not_depend_on_row_order(spark, bundle):
    """Coarse times make ties; all other columns break them."""
    coarse = {t: getattr(bundle, t).withColumn("timestamp", F.floor(F.col("timestamp") / 100_000))
              .withColumn("item_id", F.col("item_id") % 3) for t in ALL_TABLES}
    got = []
    for k in (1, 7):
        b = bundle.with_(**{t: df.repartition(k) for t, df in coarse.items()}, order_cols=("timestamp",),
                         order_is_total=False, clock="cumsum")
        ctx = Context.from_bundle(spark, b, PARAMS)
        got.append([sorted(map(tuple, f(ctx).collect())) for f in (Q.pair_agg, Q.sessionize_q, Q.session_position,
                                                                   Q.cancel_match_q)])
    assert got[0] == got[1] and all(got[0][:3])


def test_dislikes_and_undislikes_share_a_clock(spark, bundle):
    dis = spark.createDataFrame([(1, 1, 5, 0, 1), (1, 1, 6, 0, 3)], "uid long, item_id long, timestamp long, is_organic int, seq int")
    und = spark.createDataFrame([(1, 1, 10, 4)], "uid long, item_id long, timestamp long, seq int")
    b = bundle.with_(dislikes=dis, undislikes=und, order_cols=("seq",), order_is_total=False, clock="cumsum")
    rows = Q._cancel(Context.from_bundle(spark, b, PARAMS)).collect()
    assert sorted((r.abs_time_sec, r.cancelled, r.time_to_cancel) for r in rows) == [(25, 1, 80), (55, 1, 50)]


@pytest.mark.parametrize("clock", ["absolute", "cumsum"])
def test_hot_user_of_one_day_is_spread(spark, clock):
    """A user with a third of all rows, all on one day, in ranges of near equal size."""
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("uid"),
                               (F.col("id") % 10).alias("item_id"), (F.col("id") % 50).alias("timestamp"),
                               F.lit(1).alias("is_organic"), F.col("id").alias("event_id"))
    b = S.Bundle(listens=df, order_cols=("timestamp", "event_id"), clock=clock, hot_key_rows=1000, bound_source=df)
    cut = b.table("listens")
    sizes = [r["count"] for r in cut.groupBy("uid", S.CHUNK).count().orderBy(F.desc("count")).collect()]
    assert b.chunk_for("listens") == S.CHUNK and sizes[0] <= 2000
    from playstat.operators.prefix import row_index
    spread = row_index(cut, "uid", b.order("listens"), "idx", S.CHUNK).select("uid", "event_id", "idx")
    plain = row_index(df, "uid", b.order("listens"), "idx").select("uid", "event_id", "idx")
    assert spread.exceptAll(plain).isEmpty() and spread.count() == n


def test_logistic_score_equations(spark, bundle):
    """The fit is the maximum: the gradient of the likelihood is zero there."""
    from playstat.operators.enrich import with_flags
    from playstat.operators.models import logit_interaction
    rows = with_flags(bundle.listens).filter("played_ratio_pct is not null").select(
        "is_organic", "track_length_seconds", "listen_plus")
    coefs = {r["name"]: tuple(r)[1:] for r in logit_interaction(rows).collect()}
    data = [tuple(map(float, r)) for r in rows.collect()]
    n = len(data)
    mean = [sum(r[k] for r in data) / n for k in (0, 1)]
    sd = [math.sqrt(sum((r[k] - mean[k]) ** 2 for r in data) / (n - 1)) for k in (0, 1)]
    beta = [coefs[k][0] for k in ("intercept", "s_is_organic", "s_track_length_seconds", "interaction")]
    gradient = [0.0] * 4
    for a, t, y in data:
        z = [(a - mean[0]) / sd[0], (t - mean[1]) / sd[1]]
        x = [1.0, z[0], z[1], z[0] * z[1]]
        p = 1 / (1 + math.exp(-sum(b * v for b, v in zip(beta, x))))
        gradient = [g + (y - p) * v for g, v in zip(gradient, x)]
    assert all(abs(g) / n < 1e-9 for g in gradient)


def test_session_plan_has_one_exchange_on_users(spark, bundle):
    plan = Q._sessions(Context.from_bundle(spark, bundle, PARAMS))[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(uid") == 1 and "SinglePartition" not in plan
