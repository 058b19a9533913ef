import zlib

from pyspark.sql import functions as F

from playstat.llm.language_id import held_out, learn, op3_language_id, predict
from tests.llm.conftest import SF, odd_texts

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op3_language_id(spark, SF01)
    docs = spark.read.parquet(SF01 + "/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    out = held_out(F.col("doc_id"))
    changed = docs.withColumn("lang", F.when(out, F.lit("zz")).otherwise(F.col("lang"))) \
        .withColumn("source", F.lit("other"))
    a, b = (predict(d.select("doc_id", "text"), learn(d.where(~out))) for d in (docs, changed))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_odd_rows(odd, none):
    profiles = learn(odd)
    rows = predict(odd.select("doc_id", "text"), profiles).collect()
    assert len(rows) == len(odd_texts())
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "en") == letters and (letters or (r.lang_pred == "und" and r.score == 0))
    assert predict(none, profiles).count() == 0
    assert {r.lang_pred for r in predict(odd, learn(none)).collect()} == {"und"}


def test_rank_order_distance_by_hand(spark):
    from playstat.llm.language_id import Grams, ranked
    code, count = Grams().counts("ab AB, b1")
    chars = {tuple(c >> s & (1 << 21) - 1 for s in (42, 21, 0)): n for c, n in zip(code.tolist(), count.tolist())}
    named = {"".join(chr(x) if x else "_" for x in k): n for k, n in chars.items()}
    assert named["a__"] == 2 and named["b__"] == 3 and named["ab_"] == 2
    assert list(ranked(code, count, 1)) == [ord("b") << 42] or count.max() == count[code == ranked(code, count, 1)[0]][0]


def plain_ranking(texts, size=400):
    """The most frequent n-grams of some texts, counted one at a time."""
    count = {}
    for text in texts:
        line = [" "]
        for c in (text or "").lower() + " ":
            if c.isalpha():
                line.append(c)
            elif line[-1] != " ":
                line.append(" ")
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                gram = "".join(line[i:i + n])
                if gram != " " and not (n == 3 and gram[1] == " "):
                    count[gram] = count.get(gram, 0) + 1
    return sorted(count, key=lambda g: (-count[g], g))[:size]


def test_predictions_equal_plain_out_of_place_distances(spark, odd):
    docs = spark.read.parquet(SF01 + "/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 400") \
        .unionByName(odd.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", "lang")).collect()
    learned = {}
    for r in docs:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            learned.setdefault(r.lang, []).append(r.text)
    rank = {k: {g: i for i, g in enumerate(plain_ranking(v))} for k, v in learned.items()}
    assert len(rank) > 2
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("row", F.monotonically_increasing_id())
    told = predict(df, learn(df.where(~held_out(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")))))).collect()
    assert len(told) == len(docs)
    for r in told:
        own = plain_ranking([r.text])
        away = {k: sum(abs(p[g] - i) if g in p else 400 for i, g in enumerate(own)) for k, p in rank.items()}
        want = min(sorted(away), key=away.get) if own else "und"
        assert r.lang_pred == want
        assert abs(r.score - (1 - away[want] / (400 * len(own)) if own else 0)) < 1e-12
