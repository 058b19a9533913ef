import random
import re

import numpy as np

import playstat.llm.decontamination as D
from playstat.llm.decontamination import find_leaks, remove_leaks
from playstat.llm.fm_index import FMIndex, ranges
from tests.llm.conftest import PASSAGE, odd_texts, words


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, n=10):
    grams = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = tokens(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                own = grams.get(tuple(w[k:k + size]))
                if own is not None:
                    hit.update(range(k, k + size))
                    found |= own
        out.append((d, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


ITEMS = [(1, PASSAGE), (2, "One."), (3, "one TWO"), (4, None), (5, ""), (None, " ".join(words(12, 7))),
         (6, PASSAGE), (6, " ".join(words(60, 7)[20:45])), (7, "é é 日本"), (8, "same line same line same line")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in df.collect()), key=repr)


def test_odd_rows(spark, odd, none):
    assert got(find_leaks(odd, bench(spark))) == brute(odd_texts(), ITEMS)
    assert got(find_leaks(none, bench(spark))) == []
    assert got(find_leaks(odd, bench(spark, []))) == brute(odd_texts(), [])


def test_chunks_of_the_benchmark_and_small_shards(spark, odd, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_WORDS", 40)
    monkeypatch.setattr(D, "SHARD_BYTES", 2000)
    assert got(find_leaks(odd, bench(spark))) == brute(odd_texts(), ITEMS)


def test_one_worker_for_any_number_of_parts(spark, odd, monkeypatch):
    """Python workers of a task do not grow with the benchmark."""
    for words_, parts in ((10 ** 9, 1), (10, 40)):
        monkeypatch.setattr(D, "CHUNK_WORDS", words_)
        for made in (find_leaks(odd, bench(spark)), remove_leaks(odd, bench(spark))):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0]
    assert len(D._Parts(bench(spark), 10).shared) >= parts


def test_a_window_of_many_items_is_dealt(spark, monkeypatch):
    items = [(i, PASSAGE) for i in range(300)]
    monkeypatch.setattr(D, "CHUNK_WORDS", 20_000)
    parts = D._Parts(bench(spark, items), 10)
    assert len(parts.shared) == 10 and max(sum(len(o) for _, o in [(r, x) for r, x in zip(*p.by_length[10])]) for p in parts) < 3000
    rows = [(1, "before " + PASSAGE)]
    assert got(find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, items))) == brute(rows, items)


def test_clashing_helper_names(spark, odd):
    named = odd.selectExpr("*", "'x' AS _leak_words", "'y' AS _leak_hits", "1 AS words", "'z' AS items")
    made = remove_leaks(named, bench(spark))
    assert made.columns == named.columns and {(r._leak_words, r._leak_hits, r["items"]) for r in made.collect()} == {("x", "y", "z")}


def test_removal(spark, odd):
    clean = remove_leaks(odd, bench(spark))
    assert clean.columns == odd.columns
    texts = [(r.doc_id, r.text) for r in clean.collect()]
    assert (11, "Start  end of eleven") in texts and (12, "Another beginning, \nand more words") in texts
    assert 8 not in {i for i, _ in texts} and (5, None) in texts and (6, "") in texts
    left = {str(r[0]): r for r in brute(texts, ITEMS)}
    before = {str(r[0]): r for r in brute(odd_texts(), ITEMS)}
    for i in ("1", "4", "13", "16"):
        assert left[i] == before[i] and before[i][2] == 0
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in clean.collect())


def test_fm_index_finds_every_occurrence():
    r = random.Random(3)
    for _ in range(60):
        text = np.array([r.randrange(0, 5) for _ in range(r.randrange(1, 200))])
        index = FMIndex(text, 5)
        for n in (1, 2, 5):
            rows = np.array([[r.randrange(1, 5) for _ in range(n)] for _ in range(8)])
            found, low, high = index.search(rows)
            at, owner = ranges(low, high)
            got_ = sorted(zip(found[owner].tolist(), index.locate(at).tolist()))
            want = sorted((k, i) for k, row in enumerate(rows) for i in range(len(text) - n + 1)
                          if (text[i:i + n] == row).all())
            assert got_ == want
