import numpy as np
import pytest

from playstat.llm.nearest import search, usable


def brute(queries, vectors, k):
    out = []
    for q in sorted({i for i, _ in queries}):
        own = max(list(v) for i, v in queries if i == q)
        scored = []
        for i, v in vectors:
            if i != q and len(v) == len(own):
                s = 0.0
                for x, y in zip(own, v):
                    s += x * y
                scored.append((-s, i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def ask(spark, rows, k=20, every=2):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim string").repartition(3)
    v = usable(df)
    return sorted(map(tuple, search(v.where(f"vec_id % {every} = 0"), v, k).collect()))


def test_ties_odd_vectors_and_repeats(spark):
    r = np.random.default_rng(1)
    vec = lambda n=8: [float(np.float32(x)) for x in r.normal(size=n)]
    good = [(i, vec()) for i in range(1, 60)]
    good += [(100 + i, good[3][1]) for i in range(5)] + [(7, vec()), (8, vec())] + [(200, vec(3)), (202, vec(3))]
    good += [(300, [1e30, 1e-30] + [0.0] * 6), (301, [-1e30] * 8)]
    bad = [(400, None), (402, []), (404, [0.0] * 8), (406, [None] + [1.0] * 7), (408, [float("nan")] * 8),
           (410, [float("inf")] * 8), (None, vec())]
    rows = [(i, v, 1, "x") for i, v in good + bad]
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    assert ask(spark, rows) == brute([g for g in good if g[0] % 2 == 0], good, 20)


def test_blocks_and_splits(spark, monkeypatch):
    import playstat.llm.nearest as N
    monkeypatch.setattr(N, "SPLIT", 16)
    monkeypatch.setattr(N, "BLOCK", 40)
    r = np.random.default_rng(2)
    good = [(i, [float(np.float32(x)) for x in r.normal(size=5)]) for i in range(300)]
    assert ask(spark, [(i, v, 0, "") for i, v in good], 7, 20) == brute([g for g in good if g[0] % 20 == 0], good, 7)


@pytest.mark.parametrize("rows", [[], [(2, [1.0, 0.0], 0, "")]])
def test_too_few(spark, rows):
    assert ask(spark, rows) == []
