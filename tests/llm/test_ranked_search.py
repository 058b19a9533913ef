import math
import random
import re
from collections import Counter

import pytest

from playstat.llm import ranked_search as R
from tests.llm.conftest import odd_texts, words


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, q in asked.items():
        found = []
        for (doc, c), size in zip(docs, sizes):
            m = 25 + 75 * size * n // total if size else 0
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                        * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m)) for w, k in q.items() if c[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


ITEMS = [(1, "w1 W2 w3 one"), (1, "w1 W2 w3 one"), (1, "two"), (2, None), (3, ""), (None, "same line"), (4, "unheard of"),
         (5, " ".join(words(300, 4))), (6, "é É ÷ 日本"), (7, "same same same line"), (8, "one"), (8, None)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, term string, n int")


def test_odd_rows(odd, items):
    assert got(R.search(odd, items)) == brute(odd_texts(), ITEMS)


def test_empty(odd, none, items):
    assert got(R.search(none, items)) == got(R.search(odd, items.limit(0))) == got(R.search(none, items.limit(0))) == []
    assert got(R.search(odd.where("doc_id in (5, 6, 7)"), items)) == []


def crowd():
    r = random.Random(8)
    rows = [(i, " ".join(words(r.randrange(1, 80), i, 120))) for i in range(300)]
    return rows + [(1000 - i, "needle " + " ".join(words(40, 77, 120))) for i in range(200)]        # equal scores


CROWD_ITEMS = [(i, " ".join(words(random.Random(i).randrange(1, 40), 500 + i, 130))) for i in range(25)] + [(99, "needle w1")]


def test_ties_parts_and_partitions(spark, monkeypatch):
    docs = spark.createDataFrame(crowd(), "doc_id long, text string")
    items = spark.createDataFrame(CROWD_ITEMS, "item_id long, text string")
    want = brute(crowd(), CROWD_ITEMS)
    assert got(R.search(docs.repartition(7), items)) == got(R.search(docs.coalesce(1), items)) == want
    monkeypatch.setattr(R, "PART_TERMS", 90)
    assert got(R.search(docs, items)) == want


def test_small_shards_and_batches(monkeypatch):
    """The operator's own loop, shard by shard, in one process."""
    import numpy as np
    import pyarrow as pa
    rows, top = sorted(crowd()), 10
    made = [dict(item_id=i, term=int(h), n=1) for i, t in CROWD_ITEMS
            for h in R._words(pa.RecordBatch.from_pydict({"text": pa.array([t])})).hash.view(np.int64)]
    folded = Counter((r["item_id"], r["term"]) for r in made)
    q = R.Queries([dict(item_id=i, term=t, n=n) for (i, t), n in folded.items()])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows])})
    all_words = R._words(batch)
    stats = R.Statistics(len(rows), len(all_words), np.bincount(q.postings(all_words)[1], minlength=len(q.vocabulary)))
    want = brute(rows, CROWD_ITEMS)
    for size, width in ((37, 1), (500, 3), (11, 64)):
        monkeypatch.setattr(R, "BATCH", width)
        best = [R.Best(top) for _ in q.items]
        for a in range(0, len(rows), size):
            part = batch.slice(a, size)
            w = R._words(part)
            text, term, n = q.postings(w)
            shard = R.Shard(part.column("doc_id").to_numpy(), text, term,
                            stats.impact(term, n, np.diff(w.first)[text]), len(q.vocabulary))
            for own, t, k in zip(best, q.terms, q.times):
                shard.search(t, k, own)
        assert sorted(((i, k + 1, int(d), int(s)) for i, b in zip(q.items, best)
                       for k, (d, s) in enumerate(zip(b.doc, b.score))), key=repr) == want


def test_range_maximum():
    import numpy as np
    r = np.random.default_rng(1)
    x = r.integers(0, 9, 70)
    table = R.RangeMaximum(x, 70)
    a, b = np.array([(i, j) for i in range(70) for j in range(i + 1, 71)]).T
    assert table.where(a, b).tolist() == [i + int(np.argmax(x[i:j])) for i, j in zip(a, b)]
