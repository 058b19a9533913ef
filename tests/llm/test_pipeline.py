"""The pipeline against a plain Python version of each stage."""

import random
import re

import corpus_pipeline as P
from tests.llm.conftest import SF, odd_texts
from tests.llm.test_decontamination import tokens
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_packing import check
from tests.llm.test_pii import base

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text, items, n=10):
    grams = set()
    for _, t in items:
        w = tokens(t)
        grams |= {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1) if w else 0)}
    at = [m.span() for m in WORD.finditer(text)]
    w, hit = tokens(text), set()
    assert len(at) == len(w)
    for size in {len(g) for g in grams}:
        for k in range(len(w) - size + 1):
            if tuple(w[k:k + size]) in grams:
                hit.update(range(k, k + size))
    out, end = [], 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out.append(text[end:at[k][0]])
        end = at[k][1]
    return ("".join(out) + text[end:]) if hit else text, len(hit) == len(w) > 0


def hide(text):
    out, end = [], 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in base(text)):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, -b)
    return "".join(out) + text[end:]


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())

    one = P.identify(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in one.collect()) == rows and one.columns == docs.columns

    two = P.near_duplicates(spark, one, SF)
    keep = {i for i, _, c in groups(rows, 5, 80) if c == i}
    rows = [(i, t) for i, t in rows if i in keep]
    assert sorted((r.doc_id, r.text) for r in two.collect()) == rows and two.columns == docs.columns

    three = P.decontaminate(spark, two, SF)
    rows = [(i, c) for i, (c, gone) in ((i, cut(t, items)) for i, t in rows) if not gone]
    assert sorted((r.doc_id, r.text) for r in three.collect()) == rows and three.columns == docs.columns

    four = P.redact(spark, three, SF)
    rows = [(i, hide(t)) for i, t in rows]
    assert sorted((r.doc_id, r.text) for r in four.collect()) == rows and four.columns == docs.columns

    check(P.pack(spark, four, SF), rows)


def test_run_and_odd_rows(spark, odd, none, tmp_path):
    bench = spark.read.parquet(SF + "/benchmark.parquet")
    for name, docs in (("odd", odd), ("none", none)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        got = P.run(spark, folder)
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        kept = {r.doc_id for r in got.collect()}
        assert kept == ({i for i, t in odd_texts() if any(c.isalpha() for c in t or "")} - {2, 3, 9, 12, 14, 18, 19, 21, 23}
                        if name == "odd" else set())


def test_clean_documents_survive(spark):
    docs = spark.createDataFrame([(i, f"A clean text number {i} with its own words {i * 7} {i * 13}", "en", "s", 1)
                                  for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    for f in (P.identify, P.near_duplicates, P.decontaminate, P.redact):
        out = f(spark, docs, SF)
        assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_short_texts_of_a_large_alphabet_survive(spark):
    r = random.Random(3)
    often = [1 / (k + 2.7) for k in range(3500)]
    rows = [(i, "".join(chr(0x4E00 + c) for c in r.choices(range(3500), often, k=r.randint(20, 400))), "zh") for i in range(600)]
    rows += [(1000 + i, f"Some plain text number {i} in another alphabet", "en") for i in range(50)]
    rare = max(rows[0][1] + rows[1][1])
    rows += [(2000, rare, None), (2001, "βγδ αβγ", None), (2002, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in P.identify(spark, docs, SF).collect()}
    assert kept == {i for i, _, _ in rows} - {2001, 2002}
