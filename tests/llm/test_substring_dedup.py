import hashlib
import random
import re

import numpy as np

from playstat.llm.ragged import mix, windows
from playstat.llm.substring_dedup import anchors, dedup
from playstat.llm.suffix_automaton import SuffixAutomaton
from tests.llm.conftest import odd_texts, words


def brute(rows, n=50):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            if i is not None:
                g = tuple(w[k:k + n])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k:k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_odd_rows(odd):
    assert got(dedup(odd)) == brute(odd_texts())


def test_empty(none):
    assert got(dedup(none)) == []


def test_anchors_of_every_length():
    for n in range(61):
        h = mix(np.arange(n, dtype=np.uint64) * np.uint64(7) + np.uint64(n))
        grams = [int(x) for x in windows(h, 25)]
        assert [int(x) for x in anchors(h)] == [min(grams[i:i + 26]) for i in range(max(0, n - 49))]


def test_a_short_text_alone_in_its_slice(spark):
    for n in (45, 48):
        rows = [(1, " ".join(words(70_000, 3))), (2, " ".join(words(n, 4)))]
        for some in (rows, rows[1:]):
            assert got(dedup(spark.createDataFrame(some, "doc_id long, text string").coalesce(1))) == brute(some)


def mosaics():
    r, pieces = random.Random(6), [words(n, 50 + n, 3000) for n in (49, 50, 51, 80, 200, 1200)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(r.randrange(1, 4)):
            p = r.choice(pieces)
            a = r.randrange(0, max(1, len(p) - 60))
            w += words(r.randrange(0, 30), 900 + i, 100_000) + (p[a:a + r.randrange(40, 300)] if r.random() < .5 else p)
        rows.append((i * 13 % 97, " ".join(w)))
    rows += [(500 + i, " ".join(["again"] * (45 + i))) for i in range(12)]       # one word, repeated
    return rows


def test_shared_passages(spark):
    rows = mosaics()
    assert got(dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_small_shards_and_places(spark, monkeypatch):
    import playstat.llm.substring_dedup as S
    monkeypatch.setattr(S, "SHARD_WORDS", 300)
    monkeypatch.setattr(S, "PLACE_WORDS", 500)
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "BLOCKS", 2)
    rows = mosaics()
    assert got(dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_automaton_spans_are_those_of_the_windows():
    r = random.Random(1)
    for _ in range(300):
        seqs = [[r.choice("abc") for _ in range(r.randrange(0, 15))] for _ in range(3)]
        text = [r.choice("abc") for _ in range(r.randrange(0, 30))]
        for n in (1, 2, 4):
            grams = {tuple(s[i:i + n]) for s in seqs for i in range(len(s) - n + 1)}
            want = {j for i in range(len(text) - n + 1) if tuple(text[i:i + n]) in grams for j in range(i, i + n)}
            spans = SuffixAutomaton(seqs).spans(text, n)
            assert {j for a, b in spans for j in range(a, b)} == want
            assert all(x[1] < y[0] or x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_anchor_is_the_smallest_gram_of_its_window():
    import numpy as np
    from playstat.llm.ragged import windows
    h = np.random.default_rng(2).integers(0, 1 << 62, 300).astype(np.uint64)
    low, gram = anchors(h), windows(h, 25)
    assert len(low) == 251 and all(low[i] == gram[i:i + 26].min() for i in range(251))
    assert not len(anchors(h[:49]))
