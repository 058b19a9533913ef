"""The analyses on a folder of interaction tables in the domain schema."""

from pyspark.sql import functions as F

from playstat.plans import hypotheses as H
from playstat.plans import queries as Q
from playstat.plans.context import Context, Params
from playstat.sources import schemas as S
from playstat.sources.adapters import events_bundle


def _write_folder(spark, path, with_embeddings):
    b = events_bundle(spark, "/root/testdata/sf0.001", with_embeddings=True)
    # domain tables carry per-user deltas in ``timestamp`` (the clock sums them)
    from pyspark.sql import Window
    w = Window.partitionBy("uid").orderBy("ts", "event_id")
    for name, df, cols in [("listens", b.listens, S.LISTENS), ("likes", b.likes, S.LIKES),
                           ("dislikes", b.dislikes, S.DISLIKES), ("undislikes", b.undislikes, S.UNDISLIKES),
                           ("unlikes", b.likes, S.UNLIKES), ("multi_event", b.multi_event, S.MULTI_EVENT)]:
        d = df.withColumn("timestamp", F.col("timestamp") - F.coalesce(F.lag("timestamp").over(w), F.lit(0)))
        d.select(*cols, F.col("event_id").alias("seq")).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    if with_embeddings:
        b.embeddings.filter(F.col("item_id").isNotNull()).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")


def test_analyses_on_domain_folder(spark, tmp_path):
    path = str(tmp_path / "domain")
    _write_folder(spark, path, with_embeddings=True)
    ctx = Context.from_folder(spark, path, Params(session_gap=86_400, window_size=20, window_step=10),
                              order_cols=("seq",))
    assert ctx.behaviour.embeddings is not None
    prof = {r.table_name: r.row_count for r in Q.table_profile(ctx).collect()}
    assert prof["listens"] > 0 and prof["multi_event"] >= prof["listens"]
    for h in (H.h1_listen_plus, H.h2_dislike_rate, H.h3_cancellation, H.h7_session_fatigue,
              H.h9_similarity, H.h10_asymmetry, H.h11_diversity):
        res = h(ctx).collect()
        assert res and all(r.metric for r in res)
        assert len({r.confirmed for r in res}) == 1


def test_absolute_clock_folder(spark, tmp_path):
    path = str(tmp_path / "abs")
    b = events_bundle(spark, "/root/testdata/sf0.001", with_embeddings=False)
    for name, df, cols in [("listens", b.listens, S.LISTENS), ("likes", b.likes, S.LIKES),
                           ("dislikes", b.dislikes, S.DISLIKES), ("undislikes", b.undislikes, S.UNDISLIKES),
                           ("multi_event", b.multi_event, S.MULTI_EVENT)]:
        df.select(*cols).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    ctx = Context.from_folder(spark, path, Params(session_gap=86_400), clock="absolute")
    got = Q._sessions(ctx)[1].select("uid", "abs_time_sec", "session_id").collect()
    ref = Q._sessions(Context.from_bundle(spark, b, Params(session_gap=86_400)))[1].select(
        "uid", "abs_time_sec", "session_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, ref))


def test_missing_embeddings_gives_skipped(spark, tmp_path):
    path = str(tmp_path / "noemb")
    _write_folder(spark, path, with_embeddings=False)
    ctx = Context.from_folder(spark, path, order_cols=("seq",))
    r = H.h9_similarity(ctx).collect()
    assert len(r) == 1 and r[0].metric.startswith("SKIPPED") and r[0].confirmed is False


def test_runner_writes_results(spark, tmp_path, capsys):
    from playstat.plans import run
    path = str(tmp_path / "runner")
    _write_folder(spark, path, with_embeddings=True)
    out = str(tmp_path / "results")
    run.main(["--data-dir", path, "--out", out, "--session-gap", "86400", "--window-size", "20",
              "--window-step", "10", "--order-cols", "seq"], spark=spark)
    res = spark.read.parquet(out)
    assert set(r.id for r in res.select("id").distinct().collect()) == {f"H{i}" for i in range(1, 12)}
    assert "confirmed:" in capsys.readouterr().out
