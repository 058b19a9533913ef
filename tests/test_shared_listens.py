"""The listen-only analyses share one join of the volume tables."""
import datetime
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from playstat.operators.sequences import window_diversity
from playstat.plans import hypotheses as H
from playstat.plans import queries as Q
from playstat.plans.context import Context
from playstat.sources.adapters import lineitem_bundle
from playstat.sources.schemas import Bundle


@pytest.fixture
def folder(spark, tmp_path):
    rng, day = random.Random(5), datetime.datetime(1996, 1, 1)
    items = [(o, rng.choice([*range(9), 99]), 1, n, float(rng.randint(1, 50)), 10.0, rng.choice(["A", "R", "N", None]),
              rng.choice(["O", "F"]), day) for o in range(60) for n in range(1, 8)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, o % 7 if o % 11 else None) for o in range(55)],
                          "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, p + 1) for p in range(9)],
                          "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path), items


def test_listens_are_made_once_for_all_analyses(spark, folder):
    path, _ = folder
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    b = lineitem_bundle(spark, path)
    n = b.listens.count()
    b = b.with_(listens=b.listens.withColumn("played_ratio_pct", counted("played_ratio_pct")))
    ctx = Context.from_bundle(spark, b).sharing()
    got = [rows(h(ctx), "id", "metric", "value") for h in (H.h1_listen_plus, H.h5_length_interaction, H.h6_rewind)]
    assert made.value == n                                  # before: once for every pass
    plain = Context.from_bundle(spark, lineitem_bundle(spark, path))
    for g, h in zip(got, (H.h1_listen_plus, H.h5_length_interaction, H.h6_rewind)):
        for (i, m, v), (i2, m2, v2) in zip(sorted(g), sorted(rows(h(plain), "id", "metric", "value"))):
            assert (i, m) == (i2, m2) and v == pytest.approx(v2)


def test_views_of_lineitem(spark, folder):
    path, items = folder
    want = sorted((o, n, int(s == "O"), None if f == "A" and n == 7 else q * 3,
                   None if f == "R" and n == 6 else (p + 1) * 12.0)
                  for o, p, _, n, q, _, f, s, _ in items if o < 55 and p < 9)
    got = rows(lineitem_bundle(spark, path).listens, "l_orderkey", "l_linenumber", "is_organic", "played_ratio_pct",
               "track_length_seconds")
    assert sorted(got) == want


def test_rate_without_top_users_with_unknown_users_and_groups(spark):
    rng = random.Random(3)
    data = [(u, 1, 1, rng.choice([0, 1, None]), rng.choice([None, 40.0, 150.0]), 60.0)
            for u in [*range(230), None] for _ in range(rng.randint(1, 9))]
    b = Bundle(listens=spark.createDataFrame(data, "uid long, item_id long, timestamp long, is_organic int, "
                                             "played_ratio_pct double, track_length_seconds double"))
    count = {}
    for u, *_, ratio, _ in data:
        if ratio == 150.0:
            count[u] = count.get(u, 0) + 1
    known = sorted((u for u in count), key=lambda u: (-count[u], -1 if u is None else u))
    top = set(known[:int(len(known) * 0.01) + 1])
    want = []
    for g in (None, 0, 1):
        some = [int(r == 150.0) for u, _, _, o, r, _ in data if o == g and u is not None and u not in top]
        want.append((g, len(some), pytest.approx(sum(some) / len(some), abs=1e-6)))
    assert rows(Q.rewind_rate_excl_top(Context.from_bundle(spark, b))) == want


def test_shared_tables_go_when_the_results_are_written(spark, folder):
    ctx = Context.from_bundle(spark, lineitem_bundle(spark, folder[0])).sharing()
    files = Q.l_listens(ctx).listens.inputFiles()
    assert files and Q.l_listens(ctx).listens.inputFiles() == files
    ctx.release()
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_diversity_of_blocks_with_zero_null_and_missing_vectors(spark):
    rng = random.Random(8)
    vecs = {i: [rng.gauss(0, 3) for _ in range(4)] for i in range(6)} | {6: [0.0] * 4, 7: None}      # 8, 9: no row
    emb = spark.createDataFrame(list(vecs.items()), "item_id long, normalized_embed array<float>")
    seen = [rng.randrange(10) for _ in range(47)]
    indexed = spark.createDataFrame([(1, i, x) for i, x in enumerate(seen)], "uid long, idx long, item_id long")
    given = {r.item_id: r.normalized_embed for r in emb.collect()}

    def cosine(x, y):
        size = (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
        return sum(a * b for a, b in zip(x, y)) / size if size else 0.0

    want = {}
    for win in range((47 - 8) // 6 + 1):
        held = [given[x] for x in seen[win * 6:win * 6 + 8] if given.get(x)]
        pairs = [1 - cosine(x, y) for i, x in enumerate(held) for y in held[:i]]
        if held:
            want[win] = (len(held), pytest.approx(sum(pairs) / len(pairs)) if pairs else None)
    got = rows(window_diversity(indexed, emb, size=8, step=6), "win", "n_vec", "diversity")
    assert {w: (n, d) for w, n, d in got} == want
