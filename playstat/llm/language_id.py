"""Language ID by rank-order profiles of n-grams.

A profile is the ranking of the most frequent letter n-grams (n = 1, 2, 3, words
bounded by a blank). A document takes the language whose profile is nearest by
the out-of-place distance: the sum over the document's own profile of how far
each n-gram's rank is from its rank there, or the profile length where it is
absent.

Profiles are learned from about ``SAMPLE`` labelled training documents per
language, chosen by a hash of the doc_id (all of them where there are fewer);
every document is predicted from its whole text. Predicting needs no shuffle; the
profiles that are broadcast are ``PROFILE`` n-grams per language, and the letters of
the learned texts that are in no profile.

Cases: null text or a text without letters is ``und`` with score 0; so is every
text where no training document has letters. Equal distances go to the language
name that sorts first, equal counts to the n-gram that sorts first. Repeated rows
give a row each, a null doc_id counts as remainder of crc32 of the empty text,
null languages are not learned, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playstat.llm.ragged import slices
from playstat.llm.storage import table

PROFILE = 400                  # n-grams of a profile
SAMPLE = 4000                  # labelled documents per language, about
UNKNOWN = "und"
_CODE_BITS = 21
_BLANK = 0x20                  # sorts before all letters
_DENSE = 1 << 18               # largest table of trigram counts held densely


def _letters() -> np.ndarray:
    """1 for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """n-gram counts of a text."""

    def __init__(self):
        self.letter = _letters()

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(codes, counts), codes ascending and distinct; a code packs up to three code points,
        and a blank stands for a run of other characters or an end of the text."""
        empty = np.empty(0, np.int64)
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points = np.where(self.letter[points], points, 0)
        framed = np.concatenate(([0], points, [0]))
        framed = framed[np.concatenate(([True], (framed[1:] != 0) | (framed[:-1] != 0)))]
        if len(framed) < 3:
            return empty, empty
        alphabet, small = np.unique(framed, return_inverse=True)
        size = len(alphabet)
        alphabet[0] = _BLANK                      # 0 is the place after a shorter n-gram's end
        codes, counts = [], []
        for n in (1, 2, 3):
            key = np.zeros(len(small) - n + 1, np.int64)
            for j in range(n):
                key = key * size + small[j:len(small) - n + 1 + j]
            if n == 3:
                key = key[small[1:-1] != 0]       # a blank bounds words, it joins none
            if size ** n <= max(_DENSE, 4 * len(key)):
                count = np.bincount(key, minlength=size ** n)
                key = np.flatnonzero(count)
                count = count[key]
            else:
                key, count = np.unique(key, return_counts=True)
            code = np.zeros(len(key), np.int64)
            for j in range(n):
                code |= alphabet[key // size ** (n - 1 - j) % size] << (_CODE_BITS * (2 - j))
            real = code != _BLANK << 2 * _CODE_BITS
            codes.append(code[real])
            counts.append(count[real])
        code, count = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(code, kind="stable")
        return code[order], count[order]


def letters(code: np.ndarray) -> np.ndarray:
    """The codes that stand for one letter."""
    return code[code & ((1 << 2 * _CODE_BITS) - 1) == 0]


def ranked(code: np.ndarray, count: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The codes of the ``size`` largest counts, most frequent first."""
    return code[np.argsort(-count, kind="stable")[:size]]


class Profiles:
    """Rank of every n-gram in every language's profile; ``rare`` are learned letters beyond the profiles."""

    def __init__(self, by_language: dict[str, list[int]], size: int = PROFILE, rare: tuple[int, ...] = ()):
        self.size = size
        self.names = sorted(by_language)
        self.codes = np.unique(np.array([c for n in self.names for c in by_language[n]], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.codes, by_language[name]), k] = np.arange(len(by_language[name]))
        self.letters = np.union1d(letters(self.codes), np.array(rare, np.int64))

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """Language and score (1 less the distance's share of the largest) of a ranking."""
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        rank = self.rank[at]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None]))
        distance = away.sum(axis=0)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.size * len(own)))

    def share_letters(self, code: np.ndarray) -> bool:
        """Whether a learned text of any language has a letter among these codes."""
        return bool(np.isin(letters(code), self.letters).any())


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, size: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles of the labelled rows of ``docs`` (doc_id, text, lang)."""
    labelled = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for k, n in sorted(totals.items()) for x in (k, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.where(draw < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]):
        grams = Grams()
        for b in slices(batches):
            langs = b.column("lang").to_pylist()
            found = [grams.counts(t) for t in b.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                mine = [x for x, k in zip(found, langs) if k == lang]
                code, inverse = np.unique(np.concatenate([c for c, _ in mine]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([c for _, c in mine]), len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code),
                                                  pa.array(n)], ["lang", "code", "n"])

    counted = chosen.mapInArrow(count, "lang string, code long, n long") \
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    one_letter = F.col("code").bitwiseAND(F.lit((1 << 2 * _CODE_BITS) - 1)) == 0
    top = counted.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= size) | one_letter)
    by_language: dict[str, list[int]] = {}
    rare = set()
    for r in top.orderBy("lang", "rank").collect():
        if r["rank"] <= size:
            by_language.setdefault(r["lang"], []).append(r["code"])
        else:
            rare.add(r["code"])
    return Profiles(by_language, size, tuple(rare))


def predict(docs: DataFrame, profiles: Profiles, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score, under ``names``, which replace
    columns so called; only ``text`` is looked at. A third name is for whether the text has
    a letter of a learned text."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        grams = Grams()
        for b in slices(batches):
            made = [[], [], []]
            for t in b.column("text").to_pylist():
                code, count = grams.counts(t)
                name, score = shared.value.nearest(ranked(code, count, shared.value.size))
                for x, to in zip((name, score, score > 0 or shared.value.share_letters(code)), made):
                    to.append(x)
            new = [pa.array(x, kind) for x, kind in zip(made, (pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new[:len(names)]], [*b.schema.names, *names])

    schema = docs.withColumns(dict(zip(names, (F.lit(""), F.lit(0.0), F.lit(True))))).schema
    return docs.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract digest: predictions for all documents, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = learn(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), profiles).select(
        "doc_id", "held_out", "lang_pred", "score")
