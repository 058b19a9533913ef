import pytest
from pyspark.sql import functions as F

from playstat.operators import interactions as I
from playstat.operators import sequences as Q
from playstat.operators import sessions as S
from playstat.operators import vectors as V
from playstat.operators.enrich import reconstruct_time
from playstat.operators.prefix import global_prefix, lag_value, running_sum
from tests.conftest import rows


def test_clock_hand_case(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "uid long, seq long, timestamp long")
    got = rows(reconstruct_time(df, ["seq"]).orderBy("seq"), "abs_time_sec")
    assert got == [(5,), (15,), (30,)]


def test_chunked_scan_equals_plain(spark):
    import random
    rnd = random.Random(5)
    data = []
    for uid in range(3):
        t = 0
        for i in range(300 if uid == 0 else 20):        # user 0 is "hot"
            t += rnd.randint(1, 3000)
            data.append((uid, t, t // 7200, rnd.randint(0, 4)))
    df = spark.createDataFrame(data, "uid long, t long, chunk long, v long")
    a = running_sum(df, "uid", ["t"], "v", "s")
    b = running_sum(df, "uid", ["t"], "v", "s", chunk_col="chunk")
    assert sorted(rows(a, "uid", "t", "s")) == sorted(rows(b, "uid", "t", "s"))
    a = lag_value(df, "uid", ["t"], "v", "p")
    b = lag_value(df, "uid", ["t"], "v", "p", chunk_col="chunk")
    assert sorted(rows(a, "uid", "t", "p"), key=str) == sorted(rows(b, "uid", "t", "p"), key=str)


def test_global_prefix_matches_cumsum(spark):
    import random
    rnd = random.Random(2)
    keys = rnd.sample(range(100000), 3000)
    df = spark.createDataFrame([(k, rnd.randint(1, 5)) for k in keys], "k long, w long")
    got = {r.k: r.cum_before for r in global_prefix(df, "k", "w", range_rows=40).collect()}
    run, w = 0, dict(rows(df))
    for k in sorted(keys):
        assert got[k] == run
        run += w[k]
    small = {r.k: r.cum_before for r in global_prefix(df, "k", "w").collect()}
    assert small == got


def test_session_gap_is_strict(spark):
    df = spark.createDataFrame([(1, 0), (1, 1800), (1, 3601)], "uid long, abs_time_sec long")
    got = rows(S.sessionize(df, ["abs_time_sec"]).orderBy("abs_time_sec"), "session_id")
    assert got == [(0,), (0,), (1,)]


def _session_events(spark, n, organic):
    return [(1, i * 10, organic[i % len(organic)], "listen" if organic[i % len(organic)] is not None else "dislike")
            for i in range(n)]


def test_session_filter_and_positions(spark):
    ev = [(1, i * 10, 0, "listen") for i in range(5)] + [(2, i * 10, 0, "listen") for i in range(6)]
    df = spark.createDataFrame(ev, "uid long, abs_time_sec long, is_organic int, event_type string")
    p = S.session_positions(S.sessionize(df, ["abs_time_sec"]), ["abs_time_sec"])
    assert {r.uid for r in p.collect()} == {2}
    got = [r.pos_third for r in p.orderBy("pos_in_session").collect()]
    assert got == ["beginning"] * 2 + ["middle"] * 2 + ["end"] * 2


def test_session_rec_share(spark):
    ev = [(1, 0, 1, "listen"), (1, 10, 0, "listen"), (1, 20, 0, "listen"), (1, 30, None, "dislike"),
          (1, 40, 0, "listen"), (1, 50, 1, "listen"),
          (2, 0, 1, "listen"), (2, 10, 0, "listen"), (2, 20, 0, "listen"), (2, 30, 1, "listen"),
          (2, 40, None, "dislike"), (2, 50, None, "dislike")]
    df = spark.createDataFrame(ev, "uid long, abs_time_sec long, is_organic int, event_type string")
    p = S.session_positions(S.sessionize(df, ["abs_time_sec"]), ["abs_time_sec"])
    got = {r.uid: (r.rec_share, r.rec_dominated) for r in p.collect()}
    assert got[1] == (pytest.approx(0.6), True)
    assert got[2] == (0.5, False)                       # exactly one half is not dominated


def test_cancel_match_hand_case(spark):
    dis = spark.createDataFrame([(1, 7, 10, 0)], "uid long, item_id long, abs_time_sec long, is_organic int")
    und = spark.createDataFrame([(1, 7, 5), (1, 7, 20), (1, 7, 10)], "uid long, item_id long, abs_time_sec long")
    r = I.cancel_match(dis, und).first()
    assert r.cancelled == 1 and r.time_to_cancel == 10
    r = I.cancel_match(dis, und, fix_min_time=False).first()
    assert r.cancelled == 1 and r.time_to_cancel == -5
    none = spark.createDataFrame([(1, 7, 3)], "uid long, item_id long, abs_time_sec long")
    r = I.cancel_match(dis, none).first()
    assert r.cancelled == 0 and r.time_to_cancel is None


@pytest.mark.parametrize("n,expected", [(99, 0), (100, 1), (149, 1), (150, 2)])
def test_count_windows(spark, n, expected):
    df = spark.createDataFrame([(1, i, i % 7, i % 2) for i in range(n)], "uid long, t long, item_id long, is_organic int")
    st = Q.window_stats(Q.sliding_count_windows(df, ["t"]), 100)
    assert st.count() == expected


def test_entropy_values(spark):
    four = [(1, i, i, 0) for i in range(4)]
    same = [(2, i, 9, 0) for i in range(4)]
    df = spark.createDataFrame(four + same, "uid long, t long, item_id long, is_organic int")
    st = {r.uid: r.entropy for r in Q.window_stats(Q.sliding_count_windows(df, ["t"], 4, 2), 4).collect()}
    assert st[1] == pytest.approx(2.0) and st[2] == pytest.approx(0.0)


def test_cosine_and_diversity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine("a", "b")).collect()] == pytest.approx([0.0, 1.0, 0.0])
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "item_id long, normalized_embed array<float>")
    w = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 2), (3, 0, 1), (3, 1, 5)],
                              "uid long, idx long, item_id long")
    got = {r.uid: r.diversity for r in Q.window_diversity(w, emb, size=2, step=2).collect()}
    assert got[1] == pytest.approx(0.0) and got[2] == pytest.approx(1.0) and got[3] is None


def test_diversity_closed_form_equals_pairwise(spark):
    import math
    import random
    rnd = random.Random(4)
    vecs = {i: [rnd.gauss(0, 1) for _ in range(8)] for i in range(12)}
    items = [rnd.randrange(12) for _ in range(10)]
    emb = spark.createDataFrame([(k, v) for k, v in vecs.items()], "item_id long, normalized_embed array<float>")
    w = spark.createDataFrame([(1, k, i) for k, i in enumerate(items)], "uid long, idx long, item_id long")
    got = Q.window_diversity(w, emb, size=10, step=10).first().diversity
    f = {k: [float(x) for x in spark.createDataFrame([(v,)], "v array<float>").first().v] for k, v in vecs.items()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    pairs = [1 - cos(f[items[i]], f[items[j]]) for i in range(10) for j in range(i + 1, 10)]
    assert got == pytest.approx(sum(pairs) / len(pairs))


def _hist_df(spark, n_org_before, with_vec=None):
    rows_ = [(1, t, 100 + t, 1, 0) for t in range(n_org_before)] + [(1, n_org_before, 1, 0, 1)]
    return spark.createDataFrame(rows_, "uid long, t long, item_id long, is_organic int, listen_plus int")


def test_history_rules(spark):
    base = [(1, [1.0, 0.0])] + [(100 + t, [1.0, 1.0]) for t in range(30)]
    emb = spark.createDataFrame(base, "item_id long, normalized_embed array<float>")
    assert Q.history_similarity(_hist_df(spark, 2), emb, ["t"]).count() == 0
    r = Q.history_similarity(_hist_df(spark, 3), emb, ["t"]).first()
    assert r.n_org == 3 and r.cosine_sim == pytest.approx(1 / 2 ** 0.5)
    # 25 organic before: the last 20 are used; make the old ones point elsewhere
    emb2 = spark.createDataFrame([(1, [1.0, 0.0])] + [(100 + t, [0.0, 1.0] if t < 5 else [1.0, 0.0])
                                                       for t in range(25)], "item_id long, normalized_embed array<float>")
    r = Q.history_similarity(_hist_df(spark, 25), emb2, ["t"]).first()
    assert r.cosine_sim == pytest.approx(1.0)


def test_history_missing_vectors(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (100, [1.0, 0.0]), (101, [0.0, 1.0])],
                                "item_id long, normalized_embed array<float>")
    r = Q.history_similarity(_hist_df(spark, 3), emb, ["t"]).first()     # item 102 has no vector
    assert r.cosine_sim == pytest.approx(1 / 2 ** 0.5)
    none = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, normalized_embed array<float>")
    assert Q.history_similarity(_hist_df(spark, 3), none, ["t"]).count() == 0


@pytest.mark.parametrize("n_users,k", [(99, 1), (100, 2), (250, 3)])
def test_top_fraction(spark, n_users, k):
    df = spark.createDataFrame([(u, 1 + (u % 3)) for u in range(n_users)], "uid long, cnt long")
    got = rows(I.top_fraction_users(df, "cnt"))
    expect = sorted([(u, 1 + (u % 3)) for u in range(n_users)], key=lambda x: (-x[1], x[0]))[:k]
    assert sorted(got) == sorted(expect)


def test_chunked_cancel_equals_plain(spark):
    import random
    rnd = random.Random(11)
    dis = [(rnd.randint(1, 3), rnd.randint(1, 3), rnd.randint(0, 400), rnd.randint(0, 1)) for _ in range(300)]
    und = [(rnd.randint(1, 3), rnd.randint(1, 3), rnd.randint(0, 400)) for _ in range(200)]
    d = spark.createDataFrame(dis, "uid long, item_id long, abs_time_sec long, is_organic int")
    u = spark.createDataFrame(und, "uid long, item_id long, abs_time_sec long")
    a = sorted(rows(I.cancel_match(d, u, chunk_sec=None)), key=str)
    b = sorted(rows(I.cancel_match(d, u, chunk_sec=25)), key=str)
    assert a == b and any(r[4] == 1 for r in a)
    # brute force
    for uid, item, t, org, canc, ttc in a:
        later = [x[2] for x in und if x[0] == uid and x[1] == item and x[2] > t]
        assert canc == (1 if later else 0) and ttc == (min(later) - t if later else None)


def test_chunked_history_equals_plain(spark):
    import random
    rnd = random.Random(12)
    lst = []
    for uid in range(2):
        for t in range(400):
            lst.append((uid, t, rnd.randint(0, 30), int(rnd.random() < 0.6), rnd.randint(0, 1)))
    df = spark.createDataFrame(lst, "uid long, t long, item_id long, is_organic int, listen_plus int")
    emb = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(25)],
                                "item_id long, normalized_embed array<float>")
    for k, blk in [(20, 25), (5, 7), (20, 3)]:
        a = {(r.uid, r.t): r.cosine_sim
             for r in Q.history_similarity(df, emb, ["t"], k=k, chunk_rows=None).collect()}
        b = {(r.uid, r.t): r.cosine_sim
             for r in Q.history_similarity(df, emb, ["t"], k=k, chunk_rows=blk).collect()}
        assert a.keys() == b.keys() and len(a) > 100
        assert all(abs(a[x] - b[x]) < 1e-9 for x in a)


def test_count_windows_with_gaps(spark):
    # size 5, step 10: windows [0,5), [10,15), ...; rows 5..9 belong to none
    df = spark.createDataFrame([(1, i, i, 0) for i in range(25)], "uid long, t long, item_id long, is_organic int")
    w = Q.sliding_count_windows(df, ["t"], size=5, step=10)
    got = sorted((r.idx, r.win) for r in w.collect())
    assert got == [(i, i // 10) for i in range(25) if i % 10 < 5]
    assert Q.window_stats(w, 5).count() == 3
