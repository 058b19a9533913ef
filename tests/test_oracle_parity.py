"""Spark queries vs their DuckDB oracle on the smallest given tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from playstat.plans.oracle import ORACLE
from playstat.sources.schemas import CHUNK

SF = "/root/testdata/sf0.001"
TABLES = ["part", "orders", "lineitem", "events", "embeddings"]
SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}


def test_types_match_for_every_oracle_key(spark, con):
    bad = {}
    for key, sql in ORACLE.items():
        df = E.queries()[key](spark, SF)
        st = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in df.schema.fields}
        rel = con.sql(sql)
        ot = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        if st != ot:
            bad[key] = (st, ot)
    assert not bad


KEYS = ["table_profile", "enrich_listens", "listen_plus_by_group", "top_fraction_users", "pair_agg",
        "chi2_dislike", "cancel_match", "sessionize", "session_position", "activity_cutpoints",
        "mann_whitney_less", "spearman_by_group", "history_similarity", "window_entropy",
        "window_cosine_diversity", "cancel_match_cumsum", "contingency_cancel_cumsum", "cancellation_rate_by_group",
        "dislike_by_third", "zscore_columns", "avg_ranks", "trend_spearman", "history_spearman", "h1_listen_plus",
        "h4_correlation", "h6_rewind", "h7_session_fatigue", "h10_asymmetry", "h11_diversity"]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple("nan" if isinstance(r[i], float) and math.isnan(r[i])
                         else round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_parity(spark, con, key):
    df = E.queries()[key](spark, SF)
    cur = con.execute(E.oracle_sql()[key])
    ocols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(cur.fetchall(), ocols)


def test_event_clock_ignores_session_time_zone(spark, con):
    from playstat.sources.adapters import events_bundle
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = {r.event_id: r.timestamp for r in events_bundle(spark, SF, False).multi_event.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    want = dict(con.execute("SELECT event_id, epoch_us(ts) // 5000000 FROM events").fetchall())
    assert got == want


CHUNK_KEYS = ["reconstruct_time", "enrich_listens", "sessionize", "session_position", "session_fatigue",
              "history_similarity", "sliding_count_windows", "window_entropy", "sampled_user_history",
              "listen_plus_by_quartile", "like_rate_by_quartile", "trend_spearman", "rewind_rate_excl_top",
              "window_cosine_diversity", "history_spearman"]


@pytest.mark.parametrize("key", CHUNK_KEYS)
def test_parity_with_forced_chunking(spark, con, key):
    """Same oracle, with every key treated as hot: per-user scans split by day,
    joins on users/items salted, sessions salted."""
    from playstat.plans.context import Context, testdata_context
    from playstat.plans.queries import CTX_QUERIES
    from dataclasses import replace
    base = testdata_context(spark, SF)
    # every user chunked, every session of more than 5 rows salted
    ctx = Context(spark, base.volume.with_(hot_key_rows=0), base.behaviour.with_(hot_key_rows=0),
                  replace(base.params, hot_session_rows=5))
    assert ctx.behaviour.chunk_for("multi_event") == CHUNK
    df = CTX_QUERIES[key](ctx)
    cur = con.execute(E.oracle_sql()[key])
    ocols = [c[0] for c in cur.description]
    assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(cur.fetchall(), ocols)


def test_chunking_is_size_checked(spark):
    from playstat.sources.adapters import events_bundle
    b = events_bundle(spark, SF, with_embeddings=False)
    assert b.chunk_for("listens") is None                 # < 100 events per user
    assert b.with_(hot_key_rows=10).chunk_for("listens") == CHUNK
