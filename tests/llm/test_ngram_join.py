import re
import random

import pytest

from playstat.llm.components import components
from playstat.llm.ngram_join import Bands, one_of_each, shingle_sets, similar
from tests.llm.conftest import odd_texts, words


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=4, percent=85):
    """Components over doc_ids; a null id takes no part."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    sets = [(i, shingles(t, k)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_odd_rows(odd):
    assert got(similar(odd)) == brute(odd_texts())


def test_empty(none):
    assert got(similar(none)) == []


def chains():
    """Near copies around the threshold, chains, and a large group of near copies."""
    r, rows, n = random.Random(3), [], 0
    for g in range(25):
        text = words(r.choice([8, 12, 30, 60, 150, 400]), 1000 + g, 5000)
        for _ in range(r.choice([1, 2, 5, 12])):
            n += 1
            rows.append((n * 7 % 1009, " ".join(text)))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                text[r.randrange(len(text))] = f"n{n}"
    text = words(120, 77, 5000)
    for k in range(150):
        copy = text[:]
        for _ in range(k % 4):
            copy[r.randrange(120)] = f"z{k}"
        rows.append((2000 + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_chains_and_groups(spark, size, percent):
    rows = chains()
    assert got(similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size, percent)) \
        == brute(rows, size, percent)


def test_large_groups_are_compared_block_by_block(spark, monkeypatch):
    import playstat.llm.ngram_join as N
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "STAR_ROWS", 8)
    rows = chains()
    assert got(similar(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_similar_sets_share_a_signature():
    import numpy as np
    r = np.random.default_rng(4)
    bands = Bands(85)
    for _ in range(400):
        n = int(r.choice([6, 7, 13, 20, 50, 130, 700]))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        shared = a[r.permutation(len(a))]
        most = bands.differences(2 * len(a))
        gone = int(r.integers(0, most // 2 + 1))
        b = np.unique(np.concatenate((shared[gone:], r.integers(0, 1 << 63, most // 2 - gone if most // 2 > gone else 0)
                                      .astype(np.uint64) * np.uint64(2) + np.uint64(1))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_parities_bound_the_difference():
    import numpy as np
    from playstat.llm.ngram_join import _apart, folded, parities
    r = np.random.default_rng(9)
    for n in (1, 3, 31, 33, 200, 5000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for gone in {0, 1, n // 10, n // 2, n}:
            b = np.unique(np.concatenate((a[gone:], r.integers(0, 1 << 63, n // 4).astype(np.uint64))))
            if len(b):
                x, y = parities(a), parities(b)
                width = 8 * min(len(x), len(y))
                bound, true = int(_apart(folded([x], width), folded([y], width))[0]), len(np.setxor1d(a, b))
                assert bound <= true and (true > n // 5 or bound >= true * .6)


def test_one_of_each_keeps_the_smallest(odd):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    want = sorted(str(i) for (i, t) in odd_texts()
                  if i is None or next(c for d, _, c in brute(odd_texts()) if d == i) == i)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300), (61, 0)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(62)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingle_sets_fold_ascii_case_only():
    import pyarrow as pa
    from playstat.llm.ragged import text_buffer
    one, two, three = shingle_sets(*text_buffer(pa.array(["A b É d e", "a B É D E", "a b é d e"])))
    assert (one == two).all() and len(one) == 2 and not (one == three).all()
