import random

import public_tokenizers
from tokenizers import Tokenizer

from playstat.llm.token_counts import count_tokens, op10_token_counts
from tests.llm.conftest import SF, odd_texts

PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "LL", "1", "23", ".", "!?", "é", "É", "×", "÷", "—", " ",
         "　", "日本", "\x1c", "\x00", "<|endoftext|>", "<|", "|", "aaaa", "zzzz", "ß", "́", "e", "🙂", "\x0b", "\r\n",
         "İ", "Σ", "\u0085", " "]


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows),
                  key=repr)


def test_random_strings(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))) for i in range(5000)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_odd_rows(odd, none):
    assert sorted(map(tuple, count_tokens(odd).collect()), key=repr) == brute(odd_texts())
    assert count_tokens(none).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    got = op10_token_counts(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == brute(rows)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_memo_overflow_changes_nothing(spark, monkeypatch):
    import playstat.llm.pretokens as P
    import pyarrow as pa
    from playstat.llm.ragged import text_buffer
    from playstat.llm.token_counts import Counter, RankMerger
    monkeypatch.setattr(P, "MEMO_ENTRIES", 20)
    counter = Counter(RankMerger(public_tokenizers.path("byte_bpe_50k.json")))
    for seed in range(3):
        r = random.Random(seed)
        rows = [(i, "".join(r.choice(PARTS) for _ in range(12))) for i in range(200)]
        got = counter.counts(*text_buffer(pa.array([t for _, t in rows])))
        assert sorted(zip(range(200), got.tolist()), key=repr) == sorted(((i, n) for i, _, n in brute(rows)), key=repr)


def long_runs():
    r = random.Random(11)
    letters = lambda n, some: "".join(r.choice(some) for _ in range(n))
    return [letters(n, some) for n in (511, 512, 513, 514, 3000, 20_000)
            for some in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "éßaz日本", "!?.,;", "etaoinshr" * 3 + "x")]


def test_long_runs_equal_the_library(spark):
    rows = list(enumerate(long_runs() + [" ".join(long_runs()[:20]) + "\n" * 2000 + "x"]))
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_both_ways_of_merging_agree(monkeypatch):
    import numpy as np
    import playstat.llm.token_counts as T
    merger = T.RankMerger(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = [bytes(r.choice(b"aabeht ") for _ in range(r.randint(1, 60))) for _ in range(2000)]
    symbols = merger.byte_id[np.frombuffer(b"".join(texts), np.uint8)]
    sizes = np.array([len(t) for t in texts])
    batched = merger.counts(symbols, sizes)
    for bound in (0, 20):
        monkeypatch.setattr(T, "LONG", bound)
        assert (merger.counts(symbols, sizes) == batched).all()


def test_a_megabyte_of_letters():
    import time

    import numpy as np
    from playstat.llm.token_counts import Counter, RankMerger
    r = random.Random(6)
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    counter = Counter(RankMerger(public_tokenizers.path("byte_bpe_50k.json")))
    raw, start = np.frombuffer(text.encode(), np.uint8), time.time()
    got = counter.counts(raw, np.array([0, len(raw)]))
    assert time.time() - start < 10
    assert got.tolist() == [brute([(0, text)])[0][2]]
