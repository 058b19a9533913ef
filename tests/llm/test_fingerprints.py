import hashlib
import math
import random

import numpy as np
import pytest

from playstat.llm import fingerprints as P
from tests.llm.conftest import SF, odd_texts, words


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))


def plain_level(window):
    total = sum(round(window.count(b) * math.log2(window.count(b)) * P._SCALE) for b in set(window))
    return (P._MOST - total) * (P.LEVELS - 1) // P._MOST


def plain_hash(data):
    value = sum(int(P._VALUE[b]) * pow(0x5851F42D4C957F2D, i, 1 << 64) for i, b in enumerate(data))
    return int(P.mix(np.array([(value + len(data) * int(P._MUL)) % (1 << 64)], np.uint64))[0])


def plain_ranks(texts):
    count = [0] * P.LEVELS
    for t in texts:
        for i in range(len(t) - P.WIDTH + 1):
            count[plain_level(t[i:i + P.WIDTH])] += 1
    order = sorted(range(P.LEVELS), key=lambda x: (x < P.WEAK * P.LEVELS, count[x], x))
    return {x: i for i, x in enumerate(order)}


def plain_chain(t, rank):
    """List of (features, set of bits)."""
    n = len(t) - P.WIDTH + 1
    if not t:
        return []
    if n <= 0:
        picked = [(0, len(t))]
    else:
        key = [(rank[plain_level(t[i:i + P.WIDTH])], i) for i in range(n)]
        votes = [0] * n
        for i in range(n - P.RUN + 1):
            votes[min(key[i:i + P.RUN])[1]] += 1
        picked = [(i, P.WIDTH) for i in range(n) if votes[i] >= P.VOTES] or [(min(key)[1], P.WIDTH)]
    hashes = list(dict.fromkeys(plain_hash(t[i:i + w]) for i, w in picked))
    return [(len(some), {(h >> 11 * k) % P.BITS for h in some for k in range(P.HASHES)})
            for some in (hashes[i:i + P.PER_FILTER] for i in range(0, len(hashes), P.PER_FILTER))]


def plain_likeness(a, b):
    if a == b or not a or not b:
        return float(a == b)

    def over(x, y):
        most, chance = min(len(x), len(y)), len(x) * len(y) / P.BITS
        floor = chance + P.CUTOFF * (most - chance)
        return (len(x & y) - floor) / (most - floor) if len(x & y) > floor else 0.0

    def mean(a, b):
        return sum(n * max(over(x, y) for _, y in b) for n, x in a) / sum(n for n, _ in a)

    return mean(a, b) if len(a) < len(b) else mean(b, a) if len(b) < len(a) else (mean(a, b) + mean(b, a)) / 2


def plain_text(chain):
    out = []
    for n, bits in chain:
        row = np.zeros(P.BITS, bool)
        row[list(bits)] = True
        out.append(f"{n}:{np.packbits(row).tobytes().hex()}")
    return ",".join(out)


def brute(rows):
    rows = [(i, t or "") for i, t in ordered(rows)]
    rank = plain_ranks([t.encode() for _, t in rows])
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        new = t[:len(t) - q] + after[:q]
        a, e, b = (plain_chain(x.encode(), rank) for x in (t, new, after))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), plain_text(a), plain_text(e),
                    round(plain_likeness(a, e), 9), round(plain_likeness(a, b), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


SHORT = [(i, t if t is None or len(t) < 6000 else t[:6000]) for i, t in odd_texts()]


def test_against_plain_python(spark):
    r = random.Random(3)
    rows = SHORT + [(100 + i, " ".join(words(r.randrange(1, 60), i))) for i in range(30)] + [(60, "b" * 900 + "xyz")]
    made = P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got(made) == brute(rows)


def test_odd_rows_and_order(odd):
    made = P.fingerprints(odd).collect()
    assert len(made) == len(odd_texts())
    rows = [(i, t or "") for i, t in ordered(odd_texts())]
    want = [(i, len(t), hashlib.sha256(P.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest())
            for k, (i, t) in enumerate(rows)]
    assert sorted([tuple(r[:3]) for r in made], key=repr) == sorted(want, key=repr)
    by_text = {}
    for r in made:
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_text[1] == by_text[2] and by_text[5] == by_text[6] == {""}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "one text " * 30)], [(1, ""), (1, "")]])
def test_few_rows(spark, rows):
    made = got(P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    assert made == (brute(rows) if rows else [])


def test_many_partitions_and_slices(spark, monkeypatch):
    rows = [(i * 7 % 101, " ".join(words(30 + i, i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(P.fingerprints(df)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    monkeypatch.setattr(P, "SLICE", 300)
    assert got(P.fingerprints(df.coalesce(1))) == want


def test_edits_are_near_and_neighbours_are_not(spark):
    made = P.op12_fingerprints(spark, SF).where("n_chars >= 200").collect()
    assert np.mean([r["near_edited"] for r in made]) > 0.6
    assert np.mean([r["near_edited"] > r["near_next"] or r["near_next"] > 0.5 for r in made]) > 0.97
    assert np.median([r["near_next"] for r in made]) < 0.1
