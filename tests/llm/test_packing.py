import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from playstat.llm.packing import CAPACITY, op9_best_fit_packing, pack_documents, plan
from tests.llm.conftest import SF, odd_texts


def pieces(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), CAPACITY)):
            part = np.array(ids[a:a + CAPACITY], "<u4")
            out.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == pieces(rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(by)


def test_odd_rows(odd, none):
    check(pack_documents(odd), odd_texts())
    assert pack_documents(none).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    used = check(op9_best_fit_packing(spark, SF), rows)
    total = sum(p[3] for p in pieces(rows))
    assert used <= -(-total // CAPACITY) + 1


def test_many_buckets(odd, monkeypatch):
    import playstat.llm.packing as P
    monkeypatch.setattr(P, "BUCKET_ROWS", 2)
    check(pack_documents(odd), odd_texts())


def test_ids_are_kept_on_request(odd):
    rows = pack_documents(odd, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_is_no_worse_than_best_fit(seed):
    r, cap = random.Random(seed), 200
    counts = {n: r.randint(1, 40) for n in range(1, cap + 1) if r.random() < [1, .5, .2, .05, .9, .3][seed]}
    made = plan(counts, cap)
    used = Counter()
    for lengths, times in made:
        assert sum(lengths) <= cap and times > 0
        for n in lengths:
            used[n] += times
    assert used == counts
    gaps = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(cap - n)
    assert sum(t for _, t in made) <= len(gaps)


def test_exact_complements():
    assert sum(t for _, t in plan({150: 3, 50: 1, 30: 1, 20: 1, 25: 2}, 200)) == 3
    assert plan({}, 200) == []
