"""Verdict rules on fixtures with planted effects (and without them)."""

import numpy as np
import pytest

from playstat.plans import hypotheses as H
from playstat.plans.context import Context, Params
from playstat.sources.schemas import Bundle

LISTENS = ("uid long, item_id long, timestamp long, is_organic int, played_ratio_pct double, "
           "track_length_seconds double")


def _ctx(spark, effect: bool, seed: int = 0):
    rng = np.random.default_rng(seed)
    lst, likes, dislikes, multi = [], [], [], []
    t = 0
    for uid in range(400):
        for item in range(10):
            org = int(rng.random() < 0.5)
            if effect:
                ratio = float(rng.uniform(0, 70) if org == 0 else rng.uniform(30, 100))
                if rng.random() < (0.3 if org == 1 else 0.05):
                    ratio = float(rng.uniform(101, 200))          # organic rewinds more
                p_like, p_dis = (0.05, 0.30) if org == 0 else (0.30, 0.05)
            else:
                ratio = float(rng.uniform(0, 150))
                p_like = p_dis = 0.15
            t += 10
            lst.append((uid, item, t, org, ratio, float(rng.uniform(60, 400))))
            multi.append((uid, item, t, org, "listen"))
            if rng.random() < p_like:
                likes.append((uid, item, t + 1))
            if rng.random() < p_dis:
                dislikes.append((uid, item, t + 2, org))
    # sessions: 12 events, recommendation-dominated; dislikes cluster at the end when planted
    for uid in range(400, 700):
        base = uid * 100_000
        for pos in range(12):
            late = pos >= 8
            p = (0.6 if late else 0.05) if effect else 0.2
            et = "dislike" if rng.random() < p else "listen"
            multi.append((uid, pos, base + pos * 60, 0 if et == "listen" else None, et))
    sp = spark.createDataFrame
    b = Bundle(listens=sp(lst, LISTENS),
               likes=sp(likes, "uid long, item_id long, timestamp long"),
               dislikes=sp(dislikes, "uid long, item_id long, timestamp long, is_organic int"),
               undislikes=sp([(0, 0, 0)], "uid long, item_id long, timestamp long"),
               multi_event=sp(multi, "uid long, item_id long, timestamp long, is_organic int, event_type string"),
               order_cols=("timestamp",), clock="absolute")
    return Context.from_bundle(spark, b, Params(bootstrap_b=400))


@pytest.fixture(scope="module")
def planted(spark):
    return _ctx(spark, True)


@pytest.fixture(scope="module")
def null(spark):
    return _ctx(spark, False)


def _verdict(df):
    rows = df.collect()
    assert len({r.confirmed for r in rows}) == 1
    return rows[0].confirmed, {r.metric: r.value for r in rows}


@pytest.mark.parametrize("h", [H.h1_listen_plus, H.h2_dislike_rate, H.h6_rewind, H.h7_session_fatigue,
                               H.h10_asymmetry])
def test_planted_effect_is_confirmed(planted, h):
    ok, m = _verdict(h(planted))
    assert ok, m


@pytest.mark.parametrize("h", [H.h1_listen_plus, H.h6_rewind, H.h7_session_fatigue, H.h10_asymmetry])
def test_no_effect_is_not_confirmed(null, h):
    ok, m = _verdict(h(null))
    assert not ok, m


def test_h6_orientation(planted):
    _, m = _verdict(H.h6_rewind(planted))
    assert 1 < m["or_org_over_rec"] < float("inf")   # organic rewinds more -> odds ratio org/rec above 1


def test_h6_no_recommended_rewinds_is_infinite_odds(spark):
    from playstat.sources.schemas import Bundle
    rows = [(u, 1, u, u % 2, 150.0 if u % 2 == 1 and u % 3 == 0 else 50.0, 100.0) for u in range(300)]
    b = Bundle(listens=spark.createDataFrame(rows, LISTENS), order_cols=("timestamp",), clock="absolute")
    ok, m = _verdict(H.h6_rewind(Context.from_bundle(spark, b)))
    assert m["or_org_over_rec"] == float("inf") and ok
