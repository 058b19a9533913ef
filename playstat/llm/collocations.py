"""Phrase collocation mining by top-order marginalisation.

Texts are split at punctuation and line ends into pieces and those into words. Only the
longest windows are counted: every word leads one, with the words after it in its piece
as lead columns w2..w4, padded with null. A ROLLUP over (lang, w1, .., w4) then sums the
windows that share a shorter prefix, which gives the count of every word and of every
phrase of 2 to 4 words at once; no other order is ever exploded.

Nothing below ``MIN_COUNT`` can be in a candidate or in a part of one. Two sketches of
saturating counters (one for every ``BUCKET_BYTES`` of text, ``MAX_BUCKETS`` at most; added
up on the executors, their bits broadcast) tell phrases that surely occur less often: the
first those of one and two words, the second those of three and four that hold none of the
first. A window is padded from the first word on that would complete such a phrase.
What it lets through wrongly only costs time: all counts that decide are exact sums, and a
corpus beyond the largest sketch is counted with less padding. Windows of a slice of text are
counted before Spark sees them, and Spark's partial aggregation follows, so a phrase or
language that fills a third of the corpus is a few rows of each task.

Cases: a null or empty text and a text of separators only have no words; a null lang is
``und``; repeated rows count again; null and repeated doc_ids are documents like any
other; a language without candidates has no rows; an empty table gives an empty result;
other columns are ignored. Words are compared as strings in the counts; inside a slice,
windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playstat.llm.ragged import Alphabet, Words, mix, slices, text_buffer
from playstat.llm.storage import materialise, release, table

ORDER = 4                      # words of the longest phrase
MIN_COUNT = 30
INSIDE_PERCENT = 80            # a longer phrase this frequent swallows a shorter one
TOP = 2000
BUCKET_BYTES = 40              # text bytes for each counter of a sketch
MIN_BUCKETS, MAX_BUCKETS = 1 << 20, 1 << 27        # at most 16 MiB of bits
CHUNK = 1 << 18                # counters of a chunk of it
SLICE = 1 << 20                # text bytes whose windows are counted together
SALTS = 64                     # shares of a language in the first step of its ranking
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
_ALPHABET = Alphabet(b"\x20\x09" + STOPS, fold_ascii_case=True)
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
LEADS = [f"w{k}" for k in range(1, ORDER + 1)]


class _Windows:
    """The words of a slice: lower-cased bytes, the language of each, how many words of
    the same piece follow, and hashes of (lang, word), (lang, word, next word), ..."""

    def __init__(self, batch: pa.RecordBatch, order: int = ORDER):
        raw, off = text_buffer(batch.column("text"))
        self.data = _LOWER[raw]
        words = Words(self.data, off, _ALPHABET)
        self.start, self.end, self.n = words.start, words.end, len(words)
        langs = batch.column("lang").dictionary_encode()
        self.langs, code = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
        text = np.searchsorted(off, words.start, "right") - 1
        self.lang = code[text].astype(np.int64)
        of = np.array([hash_text(x) for x in self.langs.to_pylist()], _U)[self.lang] if self.n else np.empty(0, _U)
        stops = np.concatenate(([0], np.cumsum(_STOP[self.data])))
        same = (stops[words.start[1:]] == stops[words.start[:-1]]) & (text[1:] == text[:-1])
        piece = np.concatenate(([0], np.cumsum(~same))) if self.n else np.empty(0, np.int64)
        last = np.searchsorted(piece, np.arange(piece[-1] + 1), "right") if self.n else np.empty(0, np.int64)
        self.follow = (last[piece] - 1 - np.arange(self.n)) if self.n else np.empty(0, np.int64)
        self.hash = words.hash
        self.prefix = [mix(words.hash + of * _STEP)]
        for k in range(1, order):
            after = np.concatenate((words.hash[k:], np.zeros(min(k, self.n), _U)))
            self.prefix.append(mix(self.prefix[-1] * _STEP + after + _U(k)))

    def texts(self, index: np.ndarray, present: np.ndarray) -> pa.Array:
        """The words at ``index`` as strings, null where not present."""
        at = np.where(present, index, 0)
        size = np.where(present, self.end[at] - self.start[at], 0)
        off = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.start[at] - off[:-1], size) + np.arange(off[-1])
        absent = None if present.all() else pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
        kind = pa.large_binary() if off[-1] >= 1 << 31 else pa.binary()
        width = np.int64 if off[-1] >= 1 << 31 else np.int32
        made = pa.Array.from_buffers(kind, len(at), [absent, pa.py_buffer(off.astype(width)),
                                                     pa.py_buffer(self.data[source])])
        return made.cast(pa.string())


def hash_text(x: str) -> int:
    """A hash of a language name that is the same on every machine."""
    made = 0
    for b in x.encode():
        made = (made * 0x100000001B3 + b + 1) % (1 << 64)
    return made


def _place(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> _U(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _buckets(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (int(size) // BUCKET_BYTES).bit_length()))


def _fine(words: _Windows, bits: list[np.ndarray], buckets: int) -> list[np.ndarray]:
    """Per order: which windows of so many words are in a piece and hold no surely rare
    phrase, as far as the sketches so far tell (one for each two orders)."""
    fine = []
    for k, h in enumerate(words.prefix):
        ok = words.follow >= k
        if k:
            ok &= fine[-1] & np.concatenate((fine[-1][1:], np.zeros(min(1, words.n), bool)))
        if k // 2 < len(bits):
            at = _place(h, buckets)
            ok &= (bits[k // 2][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        fine.append(ok)
    return fine


def _sketch(docs: DataFrame, min_count: int, order: int, buckets: int, earlier: list):
    """Broadcast bits of the next two orders: may its phrases occur ``min_count`` times?"""
    top = np.uint8(min(255, min_count))
    orders = range(2 * len(earlier), min(order, 2 * len(earlier) + 2))

    def count(batches):
        counts = np.zeros(buckets, np.uint8)
        bits = [np.frombuffer(x.value, np.uint8) for x in earlier]
        for b in slices(batches, limit=SLICE):
            words = _Windows(b, order)
            fine = _fine(words, bits, buckets)
            for k in orders:
                at, n = np.unique(_place(words.prefix[k][fine[k]], buckets), return_counts=True)
                counts[at] = np.minimum(counts[at] + np.minimum(n, top), top)
        pack = zstandard.ZstdCompressor(level=1)
        for k in range(-(-buckets // CHUNK)):
            own = counts[k * CHUNK:(k + 1) * CHUNK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack.compress(own.tobytes())])],
                                                 ["chunk", "counts"])

    def add(batches):
        total = {}
        unpack = zstandard.ZstdDecompressor()
        for b in batches:                    # one by one: the tasks' shares never lie together
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                own = np.frombuffer(unpack.decompress(x.as_py()), np.uint8).astype(np.uint16)
                total[k] = np.minimum(total[k] + own, top).astype(np.uint8) if k in total else own.astype(np.uint8)
        for k, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own >= top).tobytes()])],
                                             ["chunk", "bits"])

    parts = (docs.mapInArrow(count, "chunk int, counts binary").repartition("chunk")
             .mapInArrow(add, "chunk int, bits binary").collect())            # ``buckets`` bits
    bits = np.zeros(-(-buckets // 8), np.uint8)
    for r in parts:
        bits[r["chunk"] * CHUNK // 8:][:len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bits.tobytes())


def lead_windows(docs: DataFrame, min_count: int = MIN_COUNT, order: int = ORDER) -> DataFrame:
    """(lang, w1, .., c): the padded longest windows of every word with their counts.

    A word that is surely rarer than ``min_count`` leads a window without words, which
    only the total of its language counts."""
    docs = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    buckets, sketches = _buckets(docs), []
    for _ in range(0, order, 2):
        sketches.append(_sketch(docs, min_count, order, buckets, list(sketches)))
    leads = LEADS[:order]

    def count(batches) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(x.value, np.uint8) for x in sketches]
        for b in slices(batches, limit=SLICE):
            words = _Windows(b, order)
            if not words.n:
                continue
            size = np.sum(_fine(words, bits, buckets), axis=0, dtype=np.int64)     # each order needs the last
            key = np.choose(size, [mix(words.lang.astype(_U) + _U(1)), *words.prefix])
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            columns = [words.langs.take(pa.array(words.lang[first]))]
            columns += [words.texts(first + k, size[first] > k) for k in range(order)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], ["lang", *leads, "c"])

    return docs.mapInArrow(count, "lang string, " + ", ".join(f"{w} string" for w in leads) + ", c long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, order: int = ORDER) -> DataFrame:
    """Written (lang, size, w1, .., f): words and phrases that occur ``min_count`` times or
    more, and each language's number of words as its row of size 0."""
    leads = LEADS[:order]
    windows = lead_windows(docs, min_count, order).groupBy("lang", *leads).agg(F.sum("c").alias("c"))
    windows = materialise(windows, "collocation-windows")
    # a prefix of k words is the rollup row whose later columns are summed up and whose
    # last word is no padding
    rolled = windows.rollup("lang", *leads).agg(F.sum("c").alias("f"), F.grouping_id().alias("up"))
    size = F.lit(None).cast("int")
    for k in range(order + 1):
        whole = F.col(leads[k - 1]).isNotNull() if k else F.lit(True)
        size = F.when((F.col("up") == (1 << (order - k)) - 1) & whole, F.lit(k)).otherwise(size)
    rolled = rolled.withColumn("size", size).where(
        F.col("size").isNotNull() & ((F.col("size") == 0) | (F.col("f") >= min_count)))
    counts = materialise(rolled.select("lang", "size", *leads, "f"), "collocation-counts")
    release(windows)
    return counts


def _wide(c) -> Column:
    return F.col(c).cast("decimal(20,0)")


def _part(leads: list[str], size: int, first: int, length: int) -> list[Column]:
    """Columns of ``length`` words of a phrase from its word ``first`` on, padded."""
    return [(F.col(leads[first + i]) if i < length else F.lit(None).cast("string")).alias(leads[i])
            for i in range(len(leads))]


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, order: int = ORDER,
                 inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """Per lang the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Parts and swallowed phrases are found by equi-joins on the words of frequent phrases.
    The ranking takes the best of ``SALTS`` shares of each language first."""
    leads = LEADS[:order]
    counts = phrase_counts(docs, min_count, order)
    phrases = counts.where("size >= 2")
    parts = counts.where("size >= 1").select("lang", *leads, F.col("f").alias("part_f"))
    same = lambda x, y: [x["lang"] == y["lang"]] + [x[w].eqNullSafe(y[w]) for w in leads]

    def words(first, length):
        return F.struct(*_part(leads, order, first, length))

    # one row per cut of a phrase, with the count of each side
    cuts = [F.when(F.col("size") == s, F.array(*[
        F.struct(F.lit(k).alias("k"), words(0, k).alias("left"), words(k, s - k).alias("right")) for k in range(1, s)]))
        for s in range(2, order + 1)]
    cut = phrases.withColumn("cut", F.explode(F.coalesce(*cuts))).select("lang", "size", *leads, "f", "cut.*")
    for side, out in (("left", "l"), ("right", "r")):
        own = parts.select(F.col("lang").alias("p_lang"), *[F.col(w).alias(f"p_{w}") for w in leads],
                           F.col("part_f").alias(out))
        cut = cut.join(own, [cut["lang"] == own["p_lang"]]
                       + [cut[side][w].eqNullSafe(own[f"p_{w}"]) for w in leads]).drop(
            "p_lang", *[f"p_{w}" for w in leads])
    cut = cut.withColumn("a", _wide("f") * F.lit(2_000_000).cast("decimal(7,0)")).withColumn(
        "b", _wide("l") + _wide("r")).withColumn("score", F.expr("a div b"))
    scored = cut.groupBy("lang", "size", *leads, "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))

    # the most frequent longer phrase that holds a phrase
    inner = [F.when(F.col("size") == s, F.array(*[
        words(i, length) for length in range(2, s) for i in range(s - length + 1)])) for s in range(3, order + 1)]
    if inner:
        longer = (phrases.where("size >= 3").withColumn("in", F.explode(F.coalesce(*inner)))
                  .groupBy("lang", *[F.col(f"in.{w}").alias(w) for w in leads]).agg(F.max("f").alias("longer_f")))
        held = scored.join(longer, same(scored, longer), "left").select(scored["*"], "longer_f")
        scored = held.where(F.col("longer_f").isNull()
                            | (_wide("longer_f") * 100 < _wide("f") * F.lit(inside_percent))).drop("longer_f")
    named = scored.select("lang", F.concat_ws(" ", *leads).alias("phrase"), F.col("f").alias("a"), "worst.l", "worst.r",
                          F.col("worst.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = (named.withColumn("share", share)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best)))
            .where(F.col("rank") <= top).drop("share", "rank"))
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))        # a row per language
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
            .where(F.col("rank") <= top).join(total, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') lang,
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
           FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w
      FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece FROM d)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) f
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) i FROM w, range(1, {ORDER + 1}) s(k)) GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT n FROM w GROUP BY 1),
c AS (SELECT lang, k, phrase, f a, string_split(phrase, ' ') w FROM f WHERE k >= 2 AND f >= {MIN_COUNT}),
cuts AS (SELECT c.lang, c.phrase, c.k, c.a, x.f l, y.f r, j, (2000000::HUGEINT * a) // (x.f + y.f) score
         FROM (SELECT *, unnest(range(1, k)) j FROM c) c
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:j], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[j + 1:c.k], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') phrase, max(a) f
           FROM (SELECT *, unnest(range(1, k - m + 2)) i FROM (SELECT *, unnest(range(2, k)) m FROM c)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank, phrase, a, l, r, n,
       score::BIGINT score
FROM worst LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang)
WHERE longer.f IS NULL OR 100::HUGEINT * longer.f < {INSIDE_PERCENT}::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
