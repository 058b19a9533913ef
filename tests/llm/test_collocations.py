import random
import re
from collections import Counter, defaultdict

import pytest

from playstat.llm import collocations as C
from tests.llm.conftest import odd_texts, words


def brute(rows, least=30, percent=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i:i + k]] = max(held[p[i:i + k]], a)
        rows = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * held[p] < percent * a or p not in held:
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus():
    r = random.Random(5)
    rows = []
    for i in range(150):
        w = [f"w{int(r.paretovariate(.7))}" if r.random() < .7 else r.choice(["Straße", "é", "日本", "a\x0bb", "x y", " "])
             for _ in range(r.randrange(0, 160))]
        for k in range(0, len(w), 9):
            w[k:k] = r.choice(([], ["New", "york", "city"], ["of", "the"], ["end."], ["one;two"], ["\t"], ["a", "a", "a", "a", "a"]))
        rows.append((r.choice(["en", "de", None, ""]), " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_against_plain_python(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert got(C.collocations(docs)) == brute(rows)
    assert got(C.collocations(docs, min_count=3, top=7)) == brute(rows, 3, top=7)
    assert got(C.collocations(docs, min_count=400)) == brute(rows, 400)          # beyond a byte
    assert len(brute(rows)) > 20


def test_small_sketch(rows):
    """A full sketch lets rare words through, never cuts a frequent phrase."""
    import numpy as np
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": pa.array([x or "und" for x, _ in rows]), "text": pa.array([t for _, t in rows])})
    w = C._Windows(batch)
    for buckets in (64, 1 << 12, 1 << 20):
        bits = []
        for first in (0, 2):
            fine = C._fine(w, bits, buckets)
            seen = [C._place(w.prefix[k][fine[k]], buckets) for k in (first, first + 1)]
            bits.append(np.packbits(np.bincount(np.concatenate(seen), minlength=buckets) >= 30))
        size = np.sum(C._fine(w, bits, buckets), axis=0)
        assert (size <= 1 + w.follow).all()
        for k, h in enumerate(w.prefix, 1):
            _, inv, n = np.unique(h[w.follow >= k - 1], return_inverse=True, return_counts=True)
            assert (size[w.follow >= k - 1][n[inv] >= 30] >= k).all()
    assert (size == 0).any()


def test_largest_sketch(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "MIN_BUCKETS", 64)
    monkeypatch.setattr(C, "MAX_BUCKETS", 64)
    assert got(C.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [("en" if i and i % 3 else None, t) for i, t in odd_texts()]
    for least in (2, 30):
        assert got(C.collocations(odd, min_count=least)) == brute(rows, least)
    assert got(C.collocations(none)) == []
    assert got(C.collocations(odd.where("doc_id in (5, 6, 7)"))) == []
